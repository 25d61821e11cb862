"""Whole flows composed from operators: search, corpus load, sync, pages, suggestions, evaluation."""
