"""Adapters of the given tables and the queries over them."""
