"""Analytics over experiment campaigns and training-data tables, as Spark jobs."""
