"""Tables from pages, and how far to trust them, as plain Spark DataFrames."""
