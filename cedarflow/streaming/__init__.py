"""Inputs are bounded tables and files; there are no streaming operators."""
