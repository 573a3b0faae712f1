"""Scalar column functions and table specifications."""
