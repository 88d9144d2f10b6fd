"""Statistics of points-to sets and of timed changes."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(pts: DataFrame) -> DataFrame:
    """node, size of the non-empty sets."""
    return pts.groupBy("node").agg(F.count("heap").alias("size"))


def set_statistics(pts: DataFrame) -> DataFrame:
    """One row: nodes with a non-empty set, and the sum of the sets' sizes."""
    return summed(sizes(pts))


def summed(sizes: DataFrame) -> DataFrame:
    """The same from the sizes, a row for each non-empty set."""
    return sizes.agg(F.count("size").alias("nodes"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"))


def by_policy(named: dict[str, DataFrame]) -> DataFrame:
    """policy, nodes, total from each policy's summed sizes."""
    rows = [sums.select(F.lit(name).alias("policy"), "nodes", "total") for name, sums in named.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def time_statistics(timings: DataFrame) -> DataFrame:
    """op, n, total_ms, mean_ms, max_ms, min_ms over timings (op, ms, affected) of changes that affected a node; with no
    such change an op has no row, and a mean of none is null, not NaN."""
    seen = timings.where("affected > 0")
    return seen.groupBy("op").agg(F.count("ms").alias("n"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"), F.min("ms").alias("min_ms"))


@contextmanager
def timed(into: dict[str, float], name: str):
    """Adds the seconds that the block takes to into[name]."""
    began = time.perf_counter()
    try:
        yield
    finally:
        into[name] = into.get(name, 0.0) + time.perf_counter() - began
