"""Readers: files, layout markup, annotation pairs."""
