"""Column builders and the small per-row helpers they need."""
