"""Functions on columns: vectors, strings, sequence encoders."""

__all__ = ["encoders", "strings", "vectors"]
