"""Tidemark: market-window analytics and corpus preparation as PySpark jobs."""
