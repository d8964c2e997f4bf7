"""helioscape: geospatial site-suitability analytics expressed as Spark DataFrames."""
