"""Operators on rasters, histograms, measurements and graphs; each returns lazy DataFrames."""
