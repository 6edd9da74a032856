"""Readers and writers: Parquet and JSON corpora, result files, WAV blobs, driver tables."""
