"""Marram: operators."""
