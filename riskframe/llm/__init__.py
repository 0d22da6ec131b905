"""Operators for preparing language-model training corpora.

Every operator takes and returns DataFrames over whole tables; nothing
outside this package imports it."""
