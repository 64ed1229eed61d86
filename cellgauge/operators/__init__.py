"""Joins and selections that need more than one built-in operator."""
