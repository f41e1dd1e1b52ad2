"""Operators from DataFrame to DataFrame, by subject."""
