"""Cardinality estimation and the catalogue of registered queries."""
