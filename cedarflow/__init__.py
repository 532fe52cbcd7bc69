"""A small, precise relational toolkit on PySpark."""
