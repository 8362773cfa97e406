"""Operators for preparing language-model training corpora, each a function from DataFrames to DataFrames."""
