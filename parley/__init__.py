"""Parley: a PySpark engine for scoring and rolling up transcribed conversations."""
