"""Chapters that arrive over time."""
