"""Readers and writers for catalogue data."""
