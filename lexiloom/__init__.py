"""Spark-first alignment of informal text with a library of named declarations."""
