"""Column expressions; none of them is a Python UDF unless its name says so."""
