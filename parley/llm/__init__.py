"""Training-data operators: packing, filtering, tokenizing, searching and deduplicating.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when present.
"""
