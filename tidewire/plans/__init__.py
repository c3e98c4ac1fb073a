"""Bindings of the test tables to news tables, and the query registry."""
