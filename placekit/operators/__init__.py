"""DataFrame operators: spatial joins, resolution, scoring, selection, serving, land."""
