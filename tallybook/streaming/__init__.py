"""Sketches over streams."""
