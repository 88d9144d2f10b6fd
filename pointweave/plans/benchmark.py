"""How long it takes to build a program's graph, and to delete and add again the edges of its instructions.

measure() times instruction by instruction, each a change of its own, which is what a program that is being edited asks
for. affected() answers for all instructions at once what deleting each would change, as one set of joins.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators import changes, delta, scc, stats, verify
from pointweave.operators.lookups import equal_sets
from pointweave.plans import pointsto
from pointweave.program import Program
from pointweave.storage import written


@dataclass
class Measured:
    policy: str
    nodes: int  # with a non-empty set
    total: int  # sum of the sets' sizes
    phases: dict[str, float]  # seconds
    rows: list[tuple[str, float, int]] = field(default_factory=list)  # op, ms, nodes affected

    def times(self, spark: SparkSession) -> DataFrame:
        """op, n, total_ms, mean_ms, max_ms, min_ms of the changes that affected a node."""
        return stats.time_statistics(spark.createDataFrame(self.rows, "op string, ms double, affected bigint"))


def _state(made: pointsto.Analysis) -> delta.State:
    seed = made.seed.select("node", "heap").distinct()
    return delta.State(made.edge, seed, made.pts, scc.nodes_of(made.edge).unionByName(seed.select("node")).distinct())


def measure(program: Program, policy, instr: DataFrame, profile: str = "reference") -> Measured:
    """Builds the graph and deletes and adds again the edges of each instruction in instr, one after the other.

    instr is what to time; with all of a large program it takes as many changes as it has instructions."""
    phases: dict[str, float] = {}
    with stats.timed(phases, "initial graph"):
        made = pointsto.build(program, policy, profile)
    sizes = stats.set_statistics(made.pts).first()
    out = Measured(policy.label, sizes.nodes, sizes.total, phases)
    state = _state(made)
    found = written(changes.affected_edges(program, made, instr), "instruction-edges")
    for row in found.select("instr_id").distinct().orderBy("instr_id").toLocalIterator():
        own = found.where(F.col("instr_id") == row.instr_id)
        before, times = state, []
        for op in ("del", "add"):
            log = own.select(F.lit(0).cast("bigint").alias("seq"), F.lit(op).alias("op"), "src", "dst")
            began = time.perf_counter()
            state, touched = delta.apply_changes(state, log)
            n = touched.count()
            times.append((op, (time.perf_counter() - began) * 1000, n))
        out.rows += [(op, ms, max(n for *_, n in times)) for op, ms, _ in times]
        if verify.level() >= 1 and not equal_sets(before.pts, state.pts):
            raise RuntimeError(f"instruction {row.instr_id}: deleting and adding its edges changes the sets")
    return out


def affected(program: Program, made: pointsto.Analysis, instr: DataFrame) -> DataFrame:
    """instr_id, lost, differ: for every instruction whose deletion changes a set, how much it takes away, and what is
    still missing with its edges back (nothing)."""
    groups = changes.affected_edges(program, made, instr).select(F.col("instr_id").alias("id"), "src", "dst")
    return verify.round_trips(_state(made), written(groups, "instruction-edges")).withColumnRenamed("id", "instr_id")
