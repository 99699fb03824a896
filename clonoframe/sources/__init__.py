"""Readers and writers."""

__all__ = ["repertoire"]
