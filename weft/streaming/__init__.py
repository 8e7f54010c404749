"""Streaming of the store analytics."""
