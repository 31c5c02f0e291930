"""Readers: catalogue tables, directory listings, volumes, name lists and rule files."""
