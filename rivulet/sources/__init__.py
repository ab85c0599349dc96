"""The store of built targets, and its formats."""
