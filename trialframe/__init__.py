"""Experiment analytics on Spark: designs, decisions, refinement, dataflow and run state as DataFrames."""
