"""Incremental runs beyond the batch pipelines."""
