"""Readers: record lines, archives, message topics, Bronze and published tables."""
