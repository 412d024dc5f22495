"""Named queries over the driver's tables (``QUERIES``) and the same results in SQL (``SQL``)."""

from gleanspark.plans import audit, files, grids, queries

QUERIES, SQL = queries.QUERIES, queries.SQL

__all__ = ["QUERIES", "SQL", "audit", "files", "grids"]
