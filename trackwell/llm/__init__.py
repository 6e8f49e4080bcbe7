"""Training-data operators: one module per operator, all on Spark DataFrames."""
