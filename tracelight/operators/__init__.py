"""The operators: search queries, detection rules and parser programs over DataFrames."""
