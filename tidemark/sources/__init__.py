"""Scans, imports and sinks."""
