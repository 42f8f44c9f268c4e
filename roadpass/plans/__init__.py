"""Whole jobs: one task in, its result tables out."""
