"""Composed pipelines and the queries of the driver."""
