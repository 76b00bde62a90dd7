"""Marram: functions."""
