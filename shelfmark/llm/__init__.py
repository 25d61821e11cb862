"""Operators of a training-data pipeline: deduplication, search, tokens, licences, mixing, sharding and classifiers.

An optional part of the library; nothing outside this folder imports it.
"""
