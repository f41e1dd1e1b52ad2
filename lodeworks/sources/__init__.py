"""Readers: pins, file trees, tar archives, installer records, verified downloads."""
