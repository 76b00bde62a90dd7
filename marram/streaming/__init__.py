"""Marram: streaming."""
