"""Rating-study analytics and corpus preparation on Spark."""
