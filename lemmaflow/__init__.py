"""Declaration-graph analytics on Spark."""
