"""Readers and writers of market files."""
