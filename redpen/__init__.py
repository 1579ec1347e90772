"""redpen: conservative text repair and topic analytics on Spark DataFrames."""
