"""Reports over the catalogue tables."""
