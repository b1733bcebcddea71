"""operators of the routing analytics."""
