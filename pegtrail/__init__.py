"""Merged-mining evidence analytics as PySpark jobs."""
