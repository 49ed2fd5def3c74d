"""Stored objects: backends, the manifest log, data files."""
