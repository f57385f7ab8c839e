"""Random-forest n-gram language models over Spark DataFrames."""
