"""quern: raster/vector extraction and zonal statistics on Spark DataFrames."""
