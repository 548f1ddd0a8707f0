"""Registry of the named queries: one Spark builder and, where SQL can express
"""

from __future__ import annotations

import contextvars
import functools
from collections.abc import Callable
from contextlib import contextmanager

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_SCOPE: contextvars.ContextVar = contextvars.ContextVar("topicspark_query_scope", default=None)


@contextmanager
def query_scope():
    """One query's memo of reused intermediate tables (never shared between queries)."""
    token = _SCOPE.set({})
    try:
        yield
    finally:
        _SCOPE.reset(token)


def reused(name: str, write: bool = True):
    """Mark a builder (spark, sf) -> DataFrame whose result several steps of a query read.

    Inside a query it is computed once and, with ``write``, written to the
    shared folder and read back, so later steps (and scalar subqueries, which
    Spark plans separately) scan the table instead of recomputing it.
    """
    def deco(fn):
        @functools.wraps(fn)
        def wrapper(spark, sf, *args, **kwargs):
            memo = _SCOPE.get()
            if memo is None or args or kwargs:
                return fn(spark, sf, *args, **kwargs)
            key = (name, sf)
            if key not in memo:
                df = fn(spark, sf)
                if write:
                    from topicspark.session import materialize
                    df = materialize(df, name)
                memo[key] = df
            return memo[key]
        return wrapper
    return deco


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @functools.wraps(fn)
        def scoped(spark, sf):
            with query_scope():
                return fn(spark, sf)

        QUERIES[name] = scoped
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def load_all() -> None:
    # importing the modules registers their queries
    from topicspark.plans import (  # noqa: F401
        q_chunk,
        q_infer,
        q_lda,
        q_model,
        q_relational,
        q_runs,
        q_text,
        q_topics,
    )
