"""Column -> Column functions. None of them is a Python UDF."""
