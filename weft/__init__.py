"""weft: content-addressed data analytics written for PySpark."""
