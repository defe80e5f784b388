"""Every registered query of the engine, each beside its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirstone.plans import data_queries, flow_queries, pricing, stream_queries, window_queries, workloads

PARTS = (pricing, window_queries, workloads, data_queries, stream_queries, flow_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for part in PARTS for k, q in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for part in PARTS for k, q in part.ORACLES.items()}
