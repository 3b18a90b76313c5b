"""Operators on names, duplicate records and texts; nothing else in the library imports this."""
