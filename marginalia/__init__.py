"""Citation-corpus curation and evaluation on Spark DataFrames."""
