"""Catalog compilation and corpus preparation as Spark DataFrame transformations."""
