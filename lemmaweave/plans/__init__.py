"""Whole plans: from words or texts to analyses."""
