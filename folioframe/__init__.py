"""folioframe: document and mathematical-markup analytics on Spark DataFrames."""
