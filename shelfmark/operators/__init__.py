"""Catalogue maintenance: snapshots, hashes, metadata, categories, moves and table changes."""
