"""Components and points-to sets under insertions and deletions, on small graphs with known results."""

import random

import pytest

from pointweave.operators import delta, scc, verify


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edges(spark, text):
    rows = [(a, b) for part in text.split() for a, bs in [part.split(">")] for b in bs]
    return frame(spark, rows, "src string, dst string")


def seeds(spark, text):
    return frame(spark, [(n, h) for n, h in (p.split(":") for p in text.split())], "node string, heap string")


def log(spark, text):
    rows = [(i, "add" if c[0] == "+" else "del", c[1], c[2]) for i, c in enumerate(text.split())]
    return frame(spark, rows, "seq bigint, op string, src string, dst string")


def sets(pts):
    out = {}
    for r in pts.collect():
        out.setdefault(r.node, set()).add(r.heap)
    return {n: "".join(sorted(h)) for n, h in out.items()}


def condensed(state):
    return {(r.src_rep, r.dst_rep) for r in scc.condensation(state.edge, state.scc).collect()}


def test_add_and_delete_sequence(spark):
    state = delta.start(edges(spark, "A>B C>D E>F B>D D>F"), seeds(spark, "A:a C:c E:e"), components=True)
    assert sets(state.pts) == {"A": "a", "B": "a", "C": "c", "D": "ac", "E": "e", "F": "ace"}
    state, touched = delta.apply_changes(state, log(spark, "+FB"))
    assert sets(state.pts) == {"A": "a", "B": "ace", "C": "c", "D": "ace", "E": "e", "F": "ace"}
    assert {r.node for r in touched.collect()} == {"B", "D"}
    assert {r.node: r.rep for r in state.scc.collect()} == {"A": "A", "B": "B", "C": "C", "D": "B", "E": "E", "F": "B"}
    state, _ = delta.apply_changes(state, log(spark, "-FB -BD"))
    assert sets(state.pts) == {"A": "a", "B": "a", "C": "c", "D": "c", "E": "e", "F": "ce"}
    assert condensed(state) == {("A", "B"), ("C", "D"), ("E", "F"), ("D", "F")}


@pytest.mark.parametrize(
    ("graph", "held", "changes", "node", "expected"),
    [
        ("A>B B>A S>A A>C B>C", "S:s", "-AC", "C", "s"),  # another edge still backs it
        ("T>XY X>F Y>F S>T", "S:s", "+FT -ST", "T", None),  # a cycle does not vouch for itself
        ("A>B", "A:o B:o", "-AB", "B", "o"),  # seeds are derived again
        ("A>B B>A S>A A>C", "S:s", "-BC", "C", "s"),  # deleting what is not there
    ],
)
def test_deletions(spark, graph, held, changes, node, expected):
    state, _ = delta.apply_changes(delta.start(edges(spark, graph), seeds(spark, held)), log(spark, changes))
    assert sets(state.pts).get(node) == expected


def test_collapse_and_restore(spark):
    state = delta.start(edges(spark, "A>B B>C C>AD D>EG E>F F>E G>H H>G"), seeds(spark, "A:a"), components=True)
    first = condensed(state)
    assert first == {("A", "D"), ("D", "E"), ("D", "G")}
    state, _ = delta.apply_changes(state, log(spark, "+FB +HC"))
    assert condensed(state) == set()
    state, _ = delta.apply_changes(state, log(spark, "-FB -HC"))
    assert condensed(state) == first
    assert verify.component_violations(state.edge, state.scc, state.seed, state.pts).isEmpty()


def test_round_trip(spark):
    state = delta.start(edges(spark, "A>E B>F C>G D>H E>I F>J I>K J>L"), seeds(spark, "A:a B:b C:c D:d"))
    _, differ = verify.round_trip(state, state.edge)
    assert differ.isEmpty()


@pytest.mark.parametrize("local", [0, 1000])
def test_components_of_random_graphs(spark, local):
    rng = random.Random(5)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(32)]
    out = {n: {b for a, b in pairs if a == n} for n in range(25)}

    def reach(n):
        seen, work = set(), [n]
        while work:
            for m in out[work.pop()]:
                if m not in seen:
                    seen.add(m)
                    work.append(m)
        return seen

    to = {n: reach(n) for n in out}
    nodes = {n for p in pairs for n in p}
    want = {n: min([n, *(m for m in to[n] if n in to[m])]) for n in nodes}
    got = scc.components(frame(spark, pairs, "src bigint, dst bigint"), local_edges=local)
    assert {r.node: r.rep for r in got.collect()} == want
