"""Reads, bookings, table checks and generators."""
