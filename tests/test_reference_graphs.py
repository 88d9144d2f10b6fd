"""The graphs with known components and sets, step by step, and random change logs against a naive fixpoint."""

import random

import pytest

from pointweave.operators import delta, scc, verify
from test_delta import condensed, edges, log, seeds, sets


def reps(state):
    return {r.node: r.rep for r in state.scc.collect()}


def reversed_condensation(state):
    return {(r.dst_rep, r.src_rep) for r in scc.reverse(scc.condensation(state.edge, state.scc)).collect()}


@pytest.mark.parametrize(
    ("graph", "steps"),
    [
        ("A>B B>C C>A", [("", set(), "AAA"), ("+AB", set(), "AAA"), ("-CA", {("A", "B"), ("B", "C")}, "ABC")]),
        ("A>B B>C", [("", {("A", "B"), ("B", "C")}, "ABC"), ("+AB", {("A", "B"), ("B", "C")}, "ABC"), ("+CA", set(), "AAA")]),
        ("A>B B>C", [("+AB", {("A", "B"), ("B", "C")}, "ABC"), ("+CB", {("A", "B")}, "ABB"), ("+CA", set(), "AAA")]),
        (
            "A>B B>C C>AD D>EG E>F F>E G>H H>G",
            [
                ("", {("A", "D"), ("D", "E"), ("D", "G")}, "AAADEEGG"), ("+FB", {("A", "G")}, "AAAAAAGG"), ("-FB", {("A", "D"), ("D", "E"), ("D", "G")}, "AAADEEGG"),
                ("+FB", {("A", "G")}, "AAAAAAGG"), ("+HC", set(), "AAAAAAAA"), ("-FB", {("A", "E")}, "AAAAEEAA"), ("-HC", {("A", "D"), ("D", "E"), ("D", "G")}, "AAADEEGG"),
            ],
        ),
    ],
)
def test_components_step_by_step(spark, graph, steps):
    state = delta.start(edges(spark, graph), seeds(spark, "A:a"), components=True)
    for change, want, members in steps:
        if change:
            state, _ = delta.apply_changes(state, log(spark, change))
        assert condensed(state) == want and reversed_condensation(state) == want
        assert reps(state) == dict(zip("ABCDEFGH", members))


def test_sets_step_by_step(spark):
    state = delta.start(edges(spark, "A>B C>D E>F B>D D>F"), seeds(spark, "A:a C:c E:e"), components=True)
    for change, b, d, f, merged in [
        ("", "a", "ac", "ace", ""), ("+FB", "ace", "ace", "ace", "BDF"), ("-FB", "a", "ac", "ace", ""), ("-BD", "a", "c", "ce", ""),
        ("+BD", "a", "ac", "ace", ""), ("+FD", "a", "ace", "ace", "DF"), ("-FD", "a", "ac", "ace", ""),
    ]:
        if change:
            state, _ = delta.apply_changes(state, log(spark, change))
        assert sets(state.pts) == {"A": "a", "B": b, "C": "c", "D": d, "E": "e", "F": f}
        assert reps(state) == {n: (min(merged) if n in merged else n) for n in "ABCDEF"}
        assert verify.component_violations(state.edge, state.scc, state.seed, state.pts).isEmpty()


def test_each_edge_deleted_and_added_again(spark):
    state = delta.start(edges(spark, "A>E B>F C>G D>H E>I F>J I>K J>L"), seeds(spark, "A:a B:b C:c D:d"))
    first = {"A": "a", "B": "b", "C": "c", "D": "d", "E": "a", "I": "a", "K": "a", "F": "b", "J": "b", "L": "b", "G": "c", "H": "d"}
    assert sets(state.pts) == first
    groups = state.edge.selectExpr("concat(src, dst) as id", "src", "dst")
    got = {r.id: (r.lost, r.differ) for r in verify.round_trips(state, groups).collect()}
    assert got == {"AE": (3, 0), "BF": (3, 0), "CG": (1, 0), "DH": (1, 0), "EI": (2, 0), "FJ": (2, 0), "IK": (1, 0), "JL": (1, 0)}
    for edge in ("AE", "IK"):
        state, _ = delta.apply_changes(state, log(spark, f"-{edge}"))
        assert edge[1] not in sets(state.pts)
        state, _ = delta.apply_changes(state, log(spark, f"+{edge}"))
        assert sets(state.pts) == first


def fixpoint(pairs, held):
    out = {n: {n} for n in held}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            more = out.get(a, set()) - out.get(b, set())
            if more:
                out.setdefault(b, set()).update(more)
                moved = True
    return {n: h for n, h in out.items() if h}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, seed):
    """Batches of random changes; a deletion that did nothing, or too much, would show in almost every batch."""
    rng = random.Random(seed)
    nodes = list(range(14))
    now = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(18)}
    held = nodes[:5]
    state = delta.start(spark.createDataFrame(sorted(now), "src bigint, dst bigint"), spark.createDataFrame([(n, n) for n in held], "node bigint, heap bigint"), components=True)
    for _ in range(3):
        before = fixpoint(now, held)
        rows = []
        for i in range(8):
            if rng.random() < 0.5 and now:
                edge = rng.choice(sorted(now))
                rows.append((i, "del", *edge))
                now = now - {edge}
            else:
                edge = (rng.choice(nodes), rng.choice(nodes))
                rows.append((i, "add", *edge))
                now = now | {edge}
        state, touched = delta.apply_changes(state, spark.createDataFrame(rows, "seq bigint, op string, src bigint, dst bigint"))
        want = fixpoint(now, held)
        got = {}
        for r in state.pts.collect():
            got.setdefault(r.node, set()).add(r.heap)
        assert got == want
        assert {r.node for r in touched.collect()} == {n for n in nodes if before.get(n) != want.get(n)}


def test_what_if_is_deletion(spark):
    """What the batched form says of each edge is what deleting it does."""
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(14)})
    held = [0, 1, 2]
    state = delta.start(spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.createDataFrame([(n, n) for n in held], "node bigint, heap bigint"))
    lost = {}
    for r in delta.what_if(state.edge, state.seed, state.pts, state.edge.selectExpr("concat(src, '>', dst) as id", "src", "dst")).collect():
        lost.setdefault(r.id, set()).add((r.node, r.heap))
    whole = {(n, h) for n, hs in fixpoint(pairs, held).items() for h in hs}
    for a, b in pairs:
        left = {(n, h) for n, hs in fixpoint([p for p in pairs if p != (a, b)], held).items() for h in hs}
        assert lost.get(f"{a}>{b}", set()) == whole - left
