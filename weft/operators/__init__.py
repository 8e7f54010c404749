"""Operators of the store analytics."""
