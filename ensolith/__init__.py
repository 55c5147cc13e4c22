"""Ensolith: ensemble calibration analytics and knowledge retrieval on Spark."""
