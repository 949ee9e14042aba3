"""Readers and writers."""

from tallyforge.sources.tables import load

__all__ = ["load"]
