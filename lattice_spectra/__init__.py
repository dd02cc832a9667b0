"""Spectral network analytics as DataFrame and SQL pipelines."""
