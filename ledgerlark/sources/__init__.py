"""Readers of files and nested records."""
