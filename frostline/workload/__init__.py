"""The registered queries: Spark jobs with their SQL counterparts on the driver tables."""
