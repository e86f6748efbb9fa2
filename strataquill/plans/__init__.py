"""Named queries of the engine: each takes (spark, sf_dir) and returns a DataFrame."""
