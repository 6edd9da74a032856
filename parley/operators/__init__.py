"""Operators over sample, turn and score tables: DataFrame in, DataFrame out."""
