"""plans of the routing analytics."""
