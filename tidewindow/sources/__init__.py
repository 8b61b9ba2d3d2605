"""Readers, writers and caches."""
