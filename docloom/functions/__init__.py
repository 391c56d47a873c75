"""Column functions of the query language: the typed lane's scalars, arrays and aggregates."""
