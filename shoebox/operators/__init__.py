"""DataFrame operators over the catalogue tables."""
