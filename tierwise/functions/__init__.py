"""functions of the routing analytics."""
