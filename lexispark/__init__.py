"""Search, curation and preparation of text corpora on Spark DataFrames."""
