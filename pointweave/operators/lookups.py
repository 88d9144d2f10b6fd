"""Set and lookup operators on relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert(edge: DataFrame, adds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after adding, edges that were new)."""
    novel = adds.select(*edge.columns).distinct().join(edge, edge.columns, "left_anti")
    return edge.unionByName(novel), novel


def delete(edge: DataFrame, dels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after deleting, edges that were there); nodes are kept elsewhere and never shrink."""
    there = dels.select(*edge.columns).distinct().join(edge, edge.columns, "left_semi")
    return edge.join(dels.select(*edge.columns), edge.columns, "left_anti"), there


def successors(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst of the edges that leave nodes(node)."""
    return edge.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select("src", "dst")


def union_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_semi")


def equal_sets(a: DataFrame, b: DataFrame) -> bool:
    return difference(a, b).isEmpty() and difference(b, a.select(*b.columns)).isEmpty()


def net_changes(log: DataFrame) -> DataFrame:
    """The last change of each edge: src, dst, op."""
    last = Window.partitionBy("src", "dst").orderBy(F.col("seq").desc())
    return log.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("src", "dst", "op")


def net_edges(log: DataFrame) -> DataFrame:
    """The edges that a change log leaves when it starts from nothing; self-edges are left out, as they add nothing."""
    return net_changes(log).where("op = 'add' and src <> dst").select("src", "dst")


def joined_text(rel: DataFrame, key: str, value: str, delimiter: str = ",") -> DataFrame:
    """key, text: the sorted values joined by the delimiter."""
    return rel.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(F.col(value).cast("string"))), delimiter).alias("text"))
