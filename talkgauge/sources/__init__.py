"""Readers and writers of the record files."""
