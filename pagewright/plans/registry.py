"""Where queries and their SQL are registered."""

from __future__ import annotations

from pagewright.plans import views as V

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; its SQL may use the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {V.SQL.strip()}{sql.rstrip() if sql.lstrip().startswith(',') else chr(10) + sql.strip()}"
        return f

    return add
