"""Operators for large training-data pipelines, one module each, and their queries in ``catalogue``."""
