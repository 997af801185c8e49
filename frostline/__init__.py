"""Frostline: cold-data tiering and lineage as Spark jobs."""

__version__ = "0.1.0"
