"""Transcript analytics on Spark."""
