"""DataFrame -> DataFrame operators. Each takes key column names as parameters
so the same operator runs on one repository or on many at once."""
