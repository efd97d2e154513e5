"""Spatial statistics over labelled point clouds, rasters and feature vectors, as Spark DataFrames."""
