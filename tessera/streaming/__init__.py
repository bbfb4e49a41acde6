"""Incremental statistics over streams."""
