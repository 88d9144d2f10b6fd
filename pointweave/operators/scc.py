"""Strongly connected components and the condensation.

A graph of up to LOCAL_EDGES edges is solved by Tarjan's algorithm in one task, in one job. Larger ones are solved by
rounds of joins:

Trimming first takes off nodes without incoming or outgoing edges, which are components of their own. On the rest the
least node that reaches each node is spread forward as its colour; the nodes of a colour that reach its root within the
colour are the root's component, whose least node the root is. They are taken off, and the rest goes round again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.fixpoint import semi_naive
from pointweave.storage import written

#: The most edges that one task takes.
LOCAL_EDGES = 500_000


def tarjan(out: dict) -> dict:
    """node -> least node of its component, from node -> successors; every node is a key. No recursion."""
    index, low, on, stack, rep, n = {}, {}, set(), [], {}, 0
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = n
        n += 1
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while not members or members[-1] != v:
                        members.append(stack.pop())
                        on.discard(members[-1])
                    least = min(members)
                    rep.update(dict.fromkeys(members, least))
    return rep


def _in_one_task(edge: DataFrame) -> DataFrame:
    def run(batches):
        out: dict = {}
        kind = None
        for batch in batches:
            kind = batch.column("src").type
            for a, b in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist()):
                out.setdefault(a, []).append(b)
                out.setdefault(b, [])
        if out:
            rep = tarjan(out)
            yield pa.RecordBatch.from_arrays([pa.array(list(rep), kind), pa.array(list(rep.values()), kind)], ["node", "rep"])

    kind = edge.schema["src"].dataType.simpleString()
    return edge.select("src", "dst").repartition(1).mapInArrow(run, f"node {kind}, rep {kind}")


def nodes_of(edge: DataFrame) -> DataFrame:
    return edge.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def connected(edge: DataFrame) -> DataFrame:
    """node, rep: the least node that edges connect it with, whatever their direction.

    Each round takes the least of a node's neighbours' representatives, and then that node's own one."""
    both = written(edge.select("src", "dst").unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "connected-edges")
    now = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("rep"))
    now = written(now, "connected")
    while True:
        near = both.join(now, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("_n")).agg(F.min("rep").alias("_r"))
        nearer = now.join(near, F.col("node") == F.col("_n")).select("node", F.col("rep").alias("_was"), F.least("rep", "_r").alias("_via"))
        jumped = nearer.join(now.select(F.col("node").alias("_m"), F.col("rep").alias("_further")), F.col("_via") == F.col("_m"))
        after = written(jumped.select("node", "_was", F.least("_via", "_further").alias("rep")), "connected")
        now = after.select("node", "rep")
        if after.where("rep <> _was").isEmpty():
            return now


def _colours(edge: DataFrame) -> DataFrame:
    """node, colour: the least node that reaches it, itself included."""
    colour = nodes_of(edge).withColumn("colour", F.col("node"))
    while True:
        pushed = colour.join(edge, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "colour")
        least = colour.withColumn("own", F.col("colour")).unionByName(pushed.withColumn("own", F.lit(None).cast(colour.schema["colour"].dataType)))
        now = written(least.groupBy("node").agg(F.min("colour").alias("colour"), F.max("own").alias("own")), "colour")
        moved = now.where("colour <> own").limit(1).count()
        colour = now.select("node", "colour")
        if not moved:
            return colour


def components(edge: DataFrame, more_nodes: DataFrame | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """scc(node, rep) of all nodes in edge(src, dst) and more_nodes(node); rep is the least node of the component."""
    every = nodes_of(edge)
    if more_nodes is not None:
        every = every.unionByName(more_nodes.select("node")).distinct()
    found: DataFrame | None = None
    left = written(edge.where("src <> dst").select("src", "dst").distinct(), "scc-edges")
    if left.limit(local_edges + 1).count() <= local_edges:
        part = _in_one_task(left)
        return every.join(part, "node", "left").select("node", F.coalesce("rep", "node").alias("rep"))
    while True:
        # nodes that cannot lie on a cycle lose their edges, until none is left of them
        while True:
            n = left.count()
            sources, sinks = left.select(F.col("src").alias("_n")).distinct(), left.select(F.col("dst").alias("_n")).distinct()
            inner = left.join(sinks, F.col("src") == F.col("_n"), "left_semi").join(sources, F.col("dst") == F.col("_n"), "left_semi")
            left = written(inner, "scc-edges") if n else left
            if not n or left.count() == n:
                break
        if left.isEmpty():
            break
        colour = _colours(left)
        cs, cd = colour.select(F.col("node").alias("src"), F.col("colour").alias("_cs")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("_cd"))
        same = left.join(cs, "src").join(cd, "dst").where("_cs = _cd").select(F.col("src").alias("_to"), F.col("dst").alias("_from"))
        roots = colour.where("node = colour").select("node", F.col("colour").alias("rep"))
        back = lambda new, same=same: new.join(same, F.col("node") == F.col("_from")).select(F.col("_to").alias("node"), "rep")
        part = semi_naive(roots, back, "scc-back")
        found = part if found is None else found.unionByName(part)
        gone = part.select(F.col("node").alias("_n"))
        left = written(left.join(gone, F.col("src") == F.col("_n"), "left_anti").join(gone, F.col("dst") == F.col("_n"), "left_anti"), "scc-edges")
    if found is None:
        return every.select("node", F.col("node").alias("rep"))
    return every.join(found, "node", "left").select("node", F.coalesce("rep", "node").alias("rep"))


def condensation(edge: DataFrame, scc: DataFrame) -> DataFrame:
    """src_rep, dst_rep: the edges between different components, each once."""
    s, d = scc.select(F.col("node").alias("src"), F.col("rep").alias("src_rep")), scc.select(F.col("node").alias("dst"), F.col("rep").alias("dst_rep"))
    return edge.join(s, "src").join(d, "dst").where("src_rep <> dst_rep").select("src_rep", "dst_rep").distinct()


def reverse(condensed: DataFrame) -> DataFrame:
    """The condensation with its edges turned around."""
    return condensed.select(F.col("dst_rep").alias("src_rep"), F.col("src_rep").alias("dst_rep"))


def merged(edge: DataFrame, scc: DataFrame, adds: DataFrame) -> DataFrame:
    """scc after adds(src, dst): components are merged on the condensation, whose new cycles are all that can change."""
    after = edge.select("src", "dst").unionByName(adds.select("src", "dst")).distinct()
    fresh = nodes_of(adds).join(scc, "node", "left_anti").select("node", F.col("node").alias("rep"))
    old = scc.unionByName(fresh)
    over = components(condensation(after, old).toDF("src", "dst"), old.select(F.col("rep").alias("node")).distinct())
    return old.join(over.select(F.col("node").alias("rep"), F.col("rep").alias("_new")), "rep").select("node", F.col("_new").alias("rep"))


def split(edge_after: DataFrame, scc: DataFrame, dels: DataFrame) -> DataFrame:
    """scc after edges were deleted: only components that lost an inner edge are computed again, on their own edges."""
    s, d = scc.select(F.col("node").alias("src"), F.col("rep").alias("_rs")), scc.select(F.col("node").alias("dst"), F.col("rep").alias("_rd"))
    touched = dels.join(s, "src").join(d, "dst").where("_rs = _rd and src <> dst").select(F.col("_rs").alias("rep")).distinct()
    inside = scc.join(touched, "rep", "left_semi")
    inner = edge_after.join(inside.select(F.col("node").alias("src"), F.col("rep").alias("_rs")), "src").join(inside.select(F.col("node").alias("dst"), F.col("rep").alias("_rd")), "dst")
    again = components(inner.where("_rs = _rd").select("src", "dst"), inside.select("node"))
    return scc.join(touched, "rep", "left_anti").select("node", "rep").unionByName(again)
