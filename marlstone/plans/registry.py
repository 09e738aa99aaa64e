"""Registry of named queries; each has Spark code and, wherever SQL can express it, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "ag1_ag4_prior_reconstruction"


def query(name: str, oracle: str | None = None):
    """Register a query under name, with its SQL text."""

    def put(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    from marlstone.plans import analysis, assessment, campaign, complete, endpoints, extra, further, positional, probes, representations, scalar, statistics  # noqa: F401
