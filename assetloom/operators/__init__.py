"""DataFrame operators: inheritance, validation, table order, resolution, manifests, signals, geometry."""
