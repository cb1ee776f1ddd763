"""Queries beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from .views import with_views


class Registry:
    """The queries of a module and their SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None, *views: str) -> Callable:
        """Registers a function (spark, sf_dir) -> DataFrame with SQL over the views, or without where SQL can't say it."""

        def add(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql is not None:
                self.oracles[function.__name__] = with_views(sql, *views) if views else sql
            return function

        return add
