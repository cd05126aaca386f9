"""Container analytics and relational data processing on Spark."""
