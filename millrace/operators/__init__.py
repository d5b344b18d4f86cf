"""Operators over entities, relations, policies and generations."""
