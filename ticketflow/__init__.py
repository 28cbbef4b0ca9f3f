"""Support-ticket analytics on PySpark: cleaning, features, similarity, scoring and monitoring."""
