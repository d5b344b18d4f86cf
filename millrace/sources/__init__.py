"""Declared schemas, and the tables, events and documents stored under them."""
