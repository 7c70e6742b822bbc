"""Retail analytics operators and reports as Spark DataFrame transformations."""
