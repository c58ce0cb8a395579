"""Content-curation operators on Spark: every operator takes and returns DataFrames."""
