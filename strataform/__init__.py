"""Analytics for engineering and simulation data, as Spark jobs."""
