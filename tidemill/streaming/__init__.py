"""Pipelines on streams of files."""
