"""Label data on Spark: build, clean, split, score."""
