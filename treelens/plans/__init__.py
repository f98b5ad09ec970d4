"""Whole runs, and the queries registered for checking."""
