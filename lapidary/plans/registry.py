"""How plan modules register their queries."""

from __future__ import annotations

from lapidary.sources import tables


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, *views: str, sql: str | None = None):
        """Registers a function as a query under its name; ``sql`` follows the views' common table expressions."""

        def register(f):
            self.queries[f.__name__] = f
            if sql:
                before = ", ".join(tables.SQL[v] for v in views)
                self.oracles[f.__name__] = (f"WITH {before}" if before else "") + sql
            return f

        return register
