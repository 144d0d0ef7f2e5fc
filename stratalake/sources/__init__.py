"""Readers and writers of landed files."""
