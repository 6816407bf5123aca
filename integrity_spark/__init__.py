"""Pipeline-integrity analytics as Spark DataFrames."""
