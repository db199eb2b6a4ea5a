"""Transforms of documents, sections and captions, scores, checks and jobs."""
