"""gridloom: local-similarity analytics over dense grids, expressed as Spark DataFrames."""
