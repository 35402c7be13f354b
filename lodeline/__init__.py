"""lodeline: vector search, lexical ranking and retrieval analytics on Spark DataFrames."""
