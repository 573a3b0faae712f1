"""Readers and writers: loosely formatted tables, nested configs, files, signals, manifests and map text."""
