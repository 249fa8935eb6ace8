"""Spark-native analytics over lodging reservations and batch answers about them."""

__version__ = "0.1.0"
