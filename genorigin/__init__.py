"""Where do samples come from? Genotype and location analytics on Spark DataFrames."""
