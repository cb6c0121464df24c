"""Bar-store, feature, evaluation and monitoring jobs for price bars on Spark."""
