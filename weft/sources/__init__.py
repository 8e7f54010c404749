"""Sources of the store analytics."""
