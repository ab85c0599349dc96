"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it may be removed as a
whole. Every operator takes and returns DataFrames and has one thin query in
:mod:`rivulet.llm.queries`.
"""
