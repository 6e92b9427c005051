"""Extraction on streams."""
