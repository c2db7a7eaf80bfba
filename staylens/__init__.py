"""Analytics over price observations with two time axes, written as Spark DataFrame jobs."""
