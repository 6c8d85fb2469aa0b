"""Analytics of Korean text on Spark DataFrames."""
