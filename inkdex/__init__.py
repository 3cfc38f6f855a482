"""Full-text search and corpus preparation on Spark DataFrames."""
