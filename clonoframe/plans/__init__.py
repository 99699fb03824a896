"""Registered queries and end-to-end workflows."""

__all__ = ["proxy", "registry", "workflows"]
