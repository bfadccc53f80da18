"""Plan helpers (lineage, skew, sizes) and the registry of queries."""
