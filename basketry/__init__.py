"""A retail price analytics engine written as PySpark DataFrame jobs."""
