"""Approximate traffic statistics from mergeable sketches: one row per pane of time.

A pane keeps a frequent-items sketch of the paths and of the addresses, and a HyperLogLog sketch of
the addresses, as binary columns of a fixed greatest size. Panes merge to any range of time or to
coarser keys without looking at the entries again, so a month of top paths costs as many rows as the
month has panes. Both sketches are Spark's own aggregates, partial on the map side.

Bounds: a frequent-items sketch of `items` is exact while at most three quarters of `items` values
occur; beyond that a count may be off by 3.5 / `items` of all rows at most, and every value more
frequent than that is listed. A HyperLogLog of `precision` p has a standard error of 1.04 / 2^(p/2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.functions import text

PANE_SECONDS = 300
ITEMS = 4096
PRECISION = 12
_SKETCHES = ("top_paths", "top_addresses")


def _filled(name: str) -> str:
    return f"{name} IS NOT NULL AND {name} <> ''"


def pane_sketches(entries: DataFrame, keys: list[str] | None = None, pane_seconds: int = PANE_SECONDS,
                  items: int = ITEMS, precision: int = PRECISION) -> DataFrame:
    """(keys, pane_start, n, top_paths, top_addresses, addresses) per pane of event time."""
    keys = ["source"] if keys is None else keys
    second = F.unix_seconds("ts")
    rows = entries.select(*keys, (F.floor(second / pane_seconds) * pane_seconds).alias("pane_start"),
                          "path", "client_ip")
    return rows.groupBy(*keys, "pane_start").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"approx_top_k_accumulate(path, {items}) FILTER (WHERE {_filled('path')})").alias("top_paths"),
        F.expr(f"approx_top_k_accumulate(client_ip, {items}) FILTER (WHERE {_filled('client_ip')})")
        .alias("top_addresses"),
        F.hll_sketch_agg(text.filled(F.col("client_ip")), precision).alias("addresses"))


def merge_panes(panes: DataFrame, keys: list[str], items: int = ITEMS) -> DataFrame:
    """The panes (or merged rows) of each key as one row of the same form."""
    return panes.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.expr(f"approx_top_k_combine({s}, {items})").alias(s) for s in _SKETCHES],
        F.hll_union_agg("addresses").alias("addresses"))


def top_of(merged: DataFrame, keys: list[str], sketch: str = "top_paths", k: int = 10) -> DataFrame:
    """(keys, value, n): the `k` most frequent values of a sketch with their estimated counts."""
    if sketch not in _SKETCHES:
        raise ValueError(f"no such sketch: {sketch}")
    return merged.select(*keys, F.expr(f"inline(approx_top_k_estimate({sketch}, {k}))")).select(
        *keys, F.col("item").alias("value"), F.col("count").alias("n"))


def addresses_of(merged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, addresses): entries and estimated distinct addresses."""
    return merged.select(*keys, "n", F.hll_sketch_estimate("addresses").alias("addresses"))
