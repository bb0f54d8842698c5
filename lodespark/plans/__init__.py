"""Registered queries: each module has ``QUERIES`` (name: (function, oracle SQL or None))."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> dict[str, tuple[Query, str | None]]:
    from lodespark.plans import catalog, coverage, evaluation, graph, literature, ranking, resolution, search, signals, texts, vocabulary

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (coverage, catalog, search, ranking, evaluation, graph, literature, texts, signals, vocabulary, resolution):
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"two queries are called {clash}")
        out |= module.QUERIES
    return out
