"""Manifests kept up to date from a stream."""
