"""Functions of the store analytics."""
