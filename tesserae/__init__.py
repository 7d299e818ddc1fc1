"""Quality-control analytics on Spark DataFrames."""
