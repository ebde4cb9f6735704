"""The expression graph, its checks and rewrites, and the planner to DataFrames."""
