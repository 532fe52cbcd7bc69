"""Catalogs, delimited text files and stored tables."""
