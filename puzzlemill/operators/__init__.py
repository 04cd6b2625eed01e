"""Relational operators of the dataset engine: DataFrame in, DataFrame out, lazy."""
