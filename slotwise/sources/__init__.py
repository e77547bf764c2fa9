"""Table declarations, Parquet storage and the mapping from the star-schema tables."""
