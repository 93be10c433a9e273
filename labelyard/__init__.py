"""Dataset governance and evaluation operators on Spark DataFrames."""
