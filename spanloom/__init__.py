"""Stand-off text annotation on Spark DataFrames."""
