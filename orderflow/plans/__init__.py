"""Whole runs put together from the operators, and the queries on the driver's tables."""
