"""How plan modules list their queries: ``@query(oracle)`` on (spark, sf_dir) -> DataFrame."""

from __future__ import annotations


class Plans:
    def __init__(self):
        self.found, self.sql = {}, {}

    def query(self, oracle: str | None = None):
        def add(f):
            self.found[f.__name__] = f
            if oracle is not None:
                self.sql[f.__name__] = oracle
            return f

        return add

    def queries(self):
        return dict(self.found)

    def oracle_sql(self):
        return dict(self.sql)
