"""N-dimensional analytics on Spark DataFrames: arrays, images, series, points, graphs."""
