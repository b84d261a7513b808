"""Tidewater: DataFrame operators for social-content analytics on Spark."""
