"""Column expressions: clock arithmetic, recodes, bins and labels."""
