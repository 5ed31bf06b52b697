"""DataFrame operators over the three signal tables."""
