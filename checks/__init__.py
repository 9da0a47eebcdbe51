"""Every operator as a query over the given tables, with the SQL it must agree with."""

from checks import feeds, imports, logs, pages, streams, texts  # noqa: F401  (modules register their queries)
from checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
