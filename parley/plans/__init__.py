"""Composed strategies, replayed model calls, and the prompt search loop."""
