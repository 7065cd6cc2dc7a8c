"""Registered queries: adapters from the given tables, jobs, and their SQL."""
