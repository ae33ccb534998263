"""canvass: survey analytics on Spark DataFrames."""
