"""Semi-naive fixpoints: points-to sets, reachability, class ancestors.

Every round is one job that joins the last round's rows with the edges and keeps what is new. Rounds are written to the
shared folder, one after the other, so lineage stays one round deep and a lost executor costs that round at most. The
edges are shuffled as Catalyst decides from their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.storage import Growing


def semi_naive(start: DataFrame, step, name: str, known: DataFrame | None = None) -> DataFrame:
    """The least relation that holds start and is closed under step, a function from new rows to derived rows.

    known: rows that are there already and need no step; they are not part of the result."""
    found = Growing(start.sparkSession, name, start.schema)
    fresh = start
    while True:
        fresh = fresh.select(*start.columns).distinct()
        if known is not None:
            fresh = fresh.join(known, start.columns, "left_anti")
        if found.parts:
            fresh = fresh.join(found.all, start.columns, "left_anti")
        fresh, n = found.add(fresh)
        if not n:
            return found.all
        fresh = step(fresh)


def along(edge: DataFrame, held: str = "heap"):
    """The step of points-to sets: what a node holds, its successors hold."""
    return lambda new: new.join(edge, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), held)


def points_to(edge: DataFrame, seed: DataFrame) -> DataFrame:
    """pts(node, heap) from edge(src, dst) and seed(node, heap): pts(y, h) if seed(y, h), or x -> y and pts(x, h)."""
    return semi_naive(seed.select("node", "heap"), along(edge), "pts")


def points_to_condensed(edge: DataFrame, seed: DataFrame) -> DataFrame:
    """The same sets, computed once for each strongly connected component and read through its members."""
    from pointweave.operators.scc import components, condensation

    scc = components(edge, seed.select("node"))
    lifted = seed.join(scc, "node").select(F.col("rep").alias("node"), "heap").distinct()
    by_rep = points_to(condensation(edge, scc).toDF("src", "dst"), lifted)
    return scc.join(by_rep.withColumnRenamed("node", "rep"), "rep").select("node", "heap")


def reachable(edge: DataFrame, start: DataFrame) -> DataFrame:
    """node: all nodes that start(node) reaches over edge, start included."""
    step = lambda new: new.join(edge, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))
    return semi_naive(start.select("node"), step, "reach")


def closure(edge: DataFrame) -> DataFrame:
    """src, dst: all pairs with a path of one edge or more."""
    by = edge.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    step = lambda new: new.join(by, F.col("dst") == F.col("_s")).select("src", F.col("_d").alias("dst"))
    return semi_naive(edge.select("src", "dst"), step, "closure")


def ancestors(classes: DataFrame) -> DataFrame:
    """class_id, ancestor, depth (the least) from class(class_id, super_id); a class is its own ancestor at depth 0.

    A hierarchy in which classes inherit from each other is walked once around."""
    up = classes.where("super_id is not null").select(F.col("class_id").alias("_c"), F.col("super_id").alias("_s"))
    found = Growing(classes.sparkSession, "ancestors", "class_id bigint, ancestor bigint, depth bigint")
    pair, depth = ["class_id", "ancestor"], 0
    fresh = classes.select("class_id", F.col("class_id").alias("ancestor")).distinct()
    while True:
        fresh, n = found.add(fresh.withColumn("depth", F.lit(depth).cast("bigint")))
        if not n:
            return found.all
        depth += 1
        fresh = fresh.join(up, F.col("ancestor") == F.col("_c")).select("class_id", F.col("_s").alias("ancestor")).distinct().join(found.all, pair, "left_anti")
