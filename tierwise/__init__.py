"""Analytics for routing queries between small and large models, as Spark plans."""
