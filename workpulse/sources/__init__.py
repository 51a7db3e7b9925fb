"""Readers that turn documents into grids and records."""
