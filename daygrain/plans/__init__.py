"""Composed reports over the canonical survey tables."""
