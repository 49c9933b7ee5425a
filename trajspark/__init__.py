"""Episode and trajectory data jobs on Spark DataFrames."""
