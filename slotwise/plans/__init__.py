"""Reusable plan shapes: skew-safe joins and positions."""
