"""Operators on repertoires: tables in, tables out."""

__all__ = ["blocks", "classify", "correct", "encode", "graph_layout", "kernel_svm", "metrics", "neighbors", "networks", "preprocess", "reconstruct", "report", "soft", "space"]
