"""Licence-demand analytics expressed as Spark DataFrame jobs."""
