"""Find and check suspicious posts in large text tables, on Spark DataFrames."""
