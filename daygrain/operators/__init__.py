"""DataFrame operators: categorisation, estimates, variance, diaries, breakdowns, trends."""
