"""Marram: sources."""
