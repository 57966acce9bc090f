"""Survey-shaped views over the provided tables, and the queries registered on them."""
