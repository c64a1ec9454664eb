"""Facts, versions and vectors as Spark DataFrames."""
