"""Operators over canonical trace tables: DataFrame in, DataFrame out."""
