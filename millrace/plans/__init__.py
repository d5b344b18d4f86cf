"""Bindings of the generated tables, and the registered queries with their SQL."""
