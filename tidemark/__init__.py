"""tidemark: recommendation-ready datasets and corpus operators on Spark DataFrames."""
