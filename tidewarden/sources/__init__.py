"""Readers, writers and the catalog."""
