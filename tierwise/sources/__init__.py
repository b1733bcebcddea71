"""sources of the routing analytics."""
