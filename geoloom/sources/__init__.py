"""Readers, writers and the fixed catalogues."""
