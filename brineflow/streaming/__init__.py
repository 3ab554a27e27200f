"""Incremental and streaming plans."""
