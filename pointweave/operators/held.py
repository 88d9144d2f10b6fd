"""Reachability over graphs that every task can hold.

Nodes are numbered, and the edges, as pairs of numbers sorted by source, go to the tasks as one broadcast. What flows is
dealt out over the tasks, each of which follows its share to the end, 64 origins at a time, one bit of a word for each.
No origin is followed twice and no round is a job. Graphs of over MOST_EDGES edges are not held; callers go by rounds of
joins then (see fixpoint).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.storage import Growing, numbered, written

#: The most edges that are held: 4 bytes each in every Python worker, four times that on the driver while they are sorted.
MOST_EDGES = 12_000_000
#: Edges followed at once, and rows let out at once.
SLICE, ROWS = 1 << 20, 1 << 16


def by_source(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each node's successors begin, and after the last; the successors)."""
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(src, minlength=n), out=begin[1:])
    return begin, dst[np.argsort(src, kind="stable")]


def with_more(begin: np.ndarray, successors: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What by_source() gave for fewer edges and nodes, with these edges among n nodes; the others are not sorted again."""
    order = np.argsort(src, kind="stable")
    begin = np.concatenate([begin, np.full(n + 1 - len(begin), begin[-1])])
    successors = np.insert(successors, begin[src[order] + 1], dst[order])
    begin[1:] += np.cumsum(np.bincount(src, minlength=n))
    return begin, successors


def _slices(degree: np.ndarray):
    """Ranges of positions with about SLICE edges each."""
    ends, at = np.cumsum(degree), 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield at, upto
        at = upto


def follow(begin: np.ndarray, successors: np.ndarray, origins: np.ndarray, nodes: np.ndarray, opened=None):
    """For every 64 distinct origins: (the origins, the nodes that any of them reaches, a word for each of these nodes).
    An origin starts at its nodes; origins are sorted. opened (see bindings.Opened) gives the edges that open where these
    origins arrive, which are followed too."""
    n = len(begin) - 1
    visited, coming = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    distinct, first = np.unique(origins, return_index=True)
    first = [*first.tolist(), len(origins)]
    for at in range(0, len(distinct), 64):
        some = distinct[at : at + 64]
        low, high = first[at], first[min(at + 64, len(distinct))]
        np.bitwise_or.at(coming, nodes[low:high], np.uint64(1) << np.searchsorted(some, origins[low:high]).astype(np.uint64))
        front, touched = np.unique(nodes[low:high]), []
        if opened:
            opened.start(some)
        while len(front):
            word = coming[front]
            coming[front] = 0
            visited[front] |= word
            touched.append(front)
            degree, reached = begin[front + 1] - begin[front], []
            for a, b in _slices(degree):
                d = degree[a:b]
                place = np.repeat(begin[front[a:b]] - (np.cumsum(d) - d), d) + np.arange(int(d.sum()))
                to = successors[place]
                new = np.repeat(word[a:b], d) & ~visited[to]
                to, new = to[new != 0], new[new != 0]
                np.bitwise_or.at(coming, to, new)
                reached.append(np.unique(to))
            front = reached[0] if len(reached) == 1 else np.unique(np.concatenate(reached))
            if opened and not len(front):
                src, dst = opened.edges(visited)
                begin, successors = with_more(begin, successors, src, dst, n)
                new = visited[src] & ~visited[dst]
                np.bitwise_or.at(coming, dst, new)
                front = np.unique(dst[new != 0])
        touched = np.unique(np.concatenate(touched))
        yield some, touched, visited[touched]
        visited[touched] = 0


class HeldGraph:
    """A graph that grows, its nodes numbered from 0. nodes: node, id."""

    def __init__(self, spark: SparkSession):
        self.spark, self.nodes, self.n = spark, Growing(spark, "held-nodes", "node string, id bigint"), 0
        self.fresh = self.nodes.all  # of the last addition's nodes, those that were new
        self.begin, self.successors = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def add(self, edge: DataFrame, more: DataFrame | None = None) -> HeldGraph | None:
        """With the edges in edge (src, dst), which it does not have yet, and the nodes in more (node), which may have none;
        None if the edges are too many to hold."""
        if len(self.successors) + edge.count() > MOST_EDGES:
            return None
        fresh, known = edge.select(F.explode(F.array("src", "dst")).alias("node")), None
        fresh = (fresh.unionByName(more) if more is not None else fresh).distinct()
        if self.n:  # few ends look for their numbers among many nodes, once
            fresh = written(fresh, "held-ends")
            known = written(self.nodes.all.join(fresh, "node"), "held-known")
            fresh = fresh.join(known, "node", "left_anti")
        if self.n and fresh.isEmpty():
            self.fresh = self.nodes.read()
        else:
            self.fresh, more = self.nodes.add(numbered(fresh, [], "id").withColumn("id", F.col("id") + (self.n - 1)))
            self.n += more
        ids = known.unionByName(self.fresh) if known is not None else self.fresh
        pairs = edge.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst").select(F.col("a").cast("int"), F.col("b").cast("int")).toArrow()
        src, dst = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        self.begin, self.successors = with_more(self.begin, self.successors, src, dst, self.n) if len(self.successors) else by_source(src, dst, self.n)
        return self

    def sent(self):
        """The graph as a broadcast."""
        return self.spark.sparkContext.broadcast((self.begin, self.successors))

    def _followed(self, start: DataFrame, out, schema: str, names: list[str], tasks: int | None = None, opening=None) -> DataFrame:
        """start: origin, id. out: from what follow() yields to columns. opening: a broadcast of what makes follow()'s opened."""
        graph, tasks = self.sent(), tasks or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def run(batches):
            from pointweave.operators import held

            origins, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b in batches:
                origins.append(b.column("origin").to_numpy())
                nodes.append(b.column("id").to_numpy())
            origins, nodes = np.concatenate(origins), np.concatenate(nodes)
            order = np.argsort(origins, kind="stable")
            for columns in out(held.follow(*graph.value, origins[order], nodes[order], opening and opening.value.opened())) if len(order) else ():
                for at in range(0, len(columns[0]), held.ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + held.ROWS]) for c in columns], names)

        return (start.repartitionByRange(tasks, "origin") if tasks > 1 else start.repartition(1)).mapInArrow(run, schema)

    def reached(self, start: DataFrame, wanted: np.ndarray | None = None, tasks: int | None = None, opening=None) -> DataFrame:
        """origin, id: the nodes (those marked in wanted alone, if given) that each origin in start (origin, id: bigint) reaches, its own included."""
        keep = None if wanted is None else self.spark.sparkContext.broadcast(wanted)

        def pairs(found):
            for origins, nodes, words in found:
                if keep is not None:
                    nodes, words = nodes[keep.value[nodes]], words[keep.value[nodes]]
                for at in range(0, len(nodes), 1 << 14):
                    bits = np.unpackbits(words[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    row, bit = np.nonzero(bits)
                    yield origins[bit], nodes[at : at + (1 << 14)][row]

        return self._followed(start, pairs, "origin bigint, id bigint", ["origin", "id"], tasks, opening)

    def sizes(self, start: DataFrame) -> DataFrame:
        """id, size: how many origins in start (origin, id: bigint) reach each node, where any does."""
        n = self.n

        def counts(found):
            size = np.zeros(n, np.int64)
            for _, nodes, words in found:
                size[nodes] += np.bitwise_count(words)
            held = np.flatnonzero(size)
            yield held, size[held]

        return self._followed(start, counts, "id bigint, size bigint", ["id", "size"]).groupBy("id").agg(F.sum("size").alias("size"))
