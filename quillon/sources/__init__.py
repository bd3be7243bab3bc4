"""Readers, writers and model files."""
