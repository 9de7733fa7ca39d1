"""Spark jobs over very large collections of toolpaths, contours, rasters, meshes and trace logs."""
