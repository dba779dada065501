"""Survey analytics (point clouds, rasters, keyed tables) as Spark DataFrame plans."""
