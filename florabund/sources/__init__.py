"""Readers of delimited text layouts and writers of results."""
