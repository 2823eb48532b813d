"""Whole reports composed from operators."""
