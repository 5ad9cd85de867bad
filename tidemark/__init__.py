"""tidemark: relations, revisions and settlement on Spark DataFrames."""
