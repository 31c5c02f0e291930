"""The operators applied to a TPC-H-like data set, each with the SQL that states its result."""
