"""isoline: vector features, rasters and map layers as Spark DataFrames."""
