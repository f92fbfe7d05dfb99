"""Booking analytics on Spark: cleaning, features, models, evaluation, monitoring."""
