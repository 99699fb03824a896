"""Incremental encoding and windowed counts."""

__all__ = ["encode_stream"]
