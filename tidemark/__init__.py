"""A point-in-time analytics engine on PySpark."""
