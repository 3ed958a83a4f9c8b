"""Spark-native quantitative image analytics: images, labels, measurements and graphs as DataFrames."""
