"""strandloom: routed sequence-graph analytics as Spark DataFrames."""
