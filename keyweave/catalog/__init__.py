"""The queries of this repository over the given tables, each with the SQL it must equal."""
