"""The operators run over the given test tables, with an SQL answer for each query."""
