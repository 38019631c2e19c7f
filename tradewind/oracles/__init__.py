"""Independent SQL statements of the registered queries, for a result check in DuckDB."""

from . import models, retail, web


def oracle_sql() -> dict[str, str]:
    return {**retail.queries(), **web.queries(), **models.queries()}
