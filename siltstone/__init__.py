"""Analytics on Spark: relational and streaming operators, and operators for training data."""
