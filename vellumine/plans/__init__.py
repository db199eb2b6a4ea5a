"""Whole flows: structuring with retries, evaluation, library call."""
