"""strandlake: interval, signal and sequence analytics on Spark DataFrames."""
