"""Registry of named queries and their SQL oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` built from the library's
operators over the stand-in inputs. The oracle is an independent DuckDB SQL
statement over the driver tables (stand-in blocks inlined as CTEs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frostline.sources import standins

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, blocks: tuple[str, ...] = (), recursive: bool = False):
    """Register ``fn`` under ``name``; ``oracle`` is prefixed by the CTEs of ``blocks``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            head = standins.with_clause(blocks) if blocks else ""
            if recursive:
                head = head.replace("WITH ", "WITH RECURSIVE ", 1)
            ORACLE[name] = head + oracle.strip()
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from frostline.plans import (  # noqa: F401
        q_context, q_history, q_jobs, q_reconcile, q_sampling, q_search, q_state,
    )
