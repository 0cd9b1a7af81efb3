"""Grounded question answering over tables, as Spark jobs."""
