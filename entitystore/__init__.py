"""A versioned, entity-keyed table store on Spark DataFrames."""
