"""Snapshots, invariants and round trips. All results are relations of offending rows; empty means that all is well."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.delta import State, apply_changes, restored, what_if
from pointweave.operators.fixpoint import along
from pointweave.operators.lookups import difference
from pointweave.operators.scc import condensation, reverse
from pointweave.storage import written


def level() -> int:
    """How much to verify, from POINTWEAVE_VERIFY: 1 round trips, 2 invariants after each step too, 3 verbose; 0 if unset or no number."""
    try:
        return int(os.environ.get("POINTWEAVE_VERIFY", "0"))
    except ValueError:
        return 0


def checks(at: int | None = None) -> list[str]:
    """The checks that are made at a level (the present one, if None)."""
    at = level() if at is None else at
    return ["round trip of each change"] * (at >= 1) + ["union invariant after each change", "arity of calls"] * (at >= 2) + ["names of changes"] * (at >= 3)


def snapshot(pts: DataFrame) -> DataFrame:
    """A copy of the sets that later changes leave alone."""
    return written(pts.select("node", "heap"), "snapshot")


def expanded(scc: DataFrame, by_rep: DataFrame) -> DataFrame:
    """node, heap of all members from the sets of their representatives."""
    return scc.join(by_rep.withColumnRenamed("node", "rep"), "rep").select("node", "heap")


def union_violations(edge: DataFrame, seed: DataFrame, pts: DataFrame) -> DataFrame:
    """kind, node, heap: missing rows that a predecessor holds, and extra rows that neither a predecessor nor a seed gives."""
    derived = along(edge.where("src <> dst"))(pts).distinct()
    missing = difference(derived, pts.select("node", "heap"))
    extra = difference(difference(pts.select("node", "heap"), derived), seed.select("node", "heap"))
    return missing.select(F.lit("missing").alias("kind"), "node", "heap").unionByName(extra.select(F.lit("extra").alias("kind"), "node", "heap"))


def component_violations(edge: DataFrame, scc: DataFrame, seed: DataFrame, pts: DataFrame) -> DataFrame:
    """The same on the condensation, where members of a component cannot vouch for one another."""
    lift = lambda rel: rel.join(scc, "node").select(F.col("rep").alias("node"), "heap").distinct()
    return union_violations(condensation(edge, scc).toDF("src", "dst"), lift(seed), lift(pts))


def inverse_violations(condensed: DataFrame, reversed_: DataFrame) -> DataFrame:
    """src_rep, dst_rep of edges that only one of the two maps has."""
    back = reverse(reversed_)
    return difference(condensed, back).unionByName(difference(back, condensed))


def round_trip(state: State, edges: DataFrame) -> tuple[State, DataFrame]:
    """Deletes and adds again the edges (src, dst) that are there. (state after, node and heap that differ)."""
    there = written(edges.select("src", "dst").distinct().join(state.edge, ["src", "dst"], "left_semi"), "round-trip")
    log = lambda op: there.select(F.lit(0).cast("long").alias("seq"), F.lit(op).alias("op"), "src", "dst")
    without, _ = apply_changes(state, log("del"))
    again, _ = apply_changes(without, log("add"))
    return again, difference(state.pts, again.pts).unionByName(difference(again.pts, state.pts))


def round_trips(state: State, groups: DataFrame) -> DataFrame:
    """id, lost, differ for each id of groups(id, src, dst) that changes a set: how many rows its deletion takes away, and
    how many are still missing when its edges are back. Each id is deleted and added on its own, all ids at once."""
    lost = written(what_if(state.edge, state.seed, state.pts, groups), "lost")
    differ = restored(state.edge, state.pts, groups, lost).groupBy("id").agg(F.count(F.lit(1)).alias("differ"))
    return lost.groupBy("id").agg(F.count(F.lit(1)).alias("lost")).join(differ, "id", "left").select("id", "lost", F.coalesce("differ", F.lit(0)).cast("long").alias("differ"))
