"""streaming of the routing analytics."""
