"""Catalogue-snapshot analytics and training-data preparation on Spark."""
