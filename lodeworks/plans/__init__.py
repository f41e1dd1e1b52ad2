"""Whole jobs and their sinks."""
