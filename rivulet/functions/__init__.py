"""Column functions: fingerprints and names."""
