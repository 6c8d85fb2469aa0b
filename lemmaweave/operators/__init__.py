"""Relational operators of the grammar."""
