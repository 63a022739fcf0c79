"""Incremental and file-stream entry points."""
