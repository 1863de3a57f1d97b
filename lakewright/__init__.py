"""Lake ingestion, quality and publishing on Spark DataFrames."""
