"""weft: document-to-graph and graph-to-answer jobs on Spark DataFrames."""
