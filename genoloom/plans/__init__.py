"""Record kinds and the lowering of queries to DataFrames."""
