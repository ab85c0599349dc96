"""Incremental, branching data pipelines on Spark."""
