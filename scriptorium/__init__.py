"""Text retrieval, link analysis and retrieval evaluation on Spark DataFrames."""
