"""cairn: document-retrieval analytics and corpus preparation on Spark DataFrames."""
