"""Listening-history analytics on Spark: import, enrich, publish, query and search."""
