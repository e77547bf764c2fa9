"""Clinic booking analytics on Spark DataFrames."""

from slotwise.sources.clinic import Clinic

__all__ = ["Clinic"]
