"""Schemas, landed tables and recorded segments."""
