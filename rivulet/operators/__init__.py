"""Branching, graph, trigger and introspection operators over DataFrames."""
