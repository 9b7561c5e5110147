"""quarry: a small relational engine whose execution is left to Spark."""
