"""Operators for preparing training data at scale: one module per operator, registered through ``queries.py``."""
