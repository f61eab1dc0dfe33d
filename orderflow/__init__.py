"""orderflow: extract, check and merge purchase-order lines as Spark jobs."""

__version__ = "0.1.0"
