"""Graphs that every task can hold, against brute force and against rounds of joins."""

import random

import numpy as np

from pointweave import catalog, schema, storage
from pointweave.functions.context import CallString
from pointweave.operators import changes, held, hierarchy
from pointweave.plans import pointsto
from pointweave.program import Program


def test_follow_is_search():
    rng = random.Random(5)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(90)]
    begin, to = held.by_source(np.array([a for a, _ in edges], np.int32), np.array([b for _, b in edges], np.int32), n)
    starts = sorted((k, rng.randrange(n)) for k in range(150) for _ in range(2))
    got = set()
    for origins, nodes, words in held.follow(begin, to, np.array([k for k, _ in starts]), np.array([v for _, v in starts])):
        got |= {(int(o), int(v)) for v, w in zip(nodes, words) for i, o in enumerate(origins) if int(w) >> i & 1}
    want = set()
    for k, v in starts:
        work = [v]
        while work:
            if (k, x := work.pop()) not in want:
                want.add((k, x))
                work += [b for a, b in edges if a == x]
    assert got == want


def calls_of_calls(spark, chain=0):
    """Classes 1 and 2 share a method, 3 overrides it; function 10 calls what two receivers hold, one of them at the end
    of a chain of assignments."""
    f = lambda rows, s: spark.createDataFrame(rows, s)
    functions = [(10, 9, True, 10), (11, 1, False, 1), (12, 3, False, 1)]
    instr = [
        (1, 10, "alloc", 100, None, None, 2, None, None), (2, 10, "alloc", 101, None, None, 3, None, None), (3, 10, "vcall", 102, 100, None, None, 1, []),
        (4, 11, "alloc", 111, None, None, 3, None, None), (5, 11, "return", None, 111, None, None, None, None),
        (6, 12, "return", None, 120, None, None, None, None), (7, 10, "vcall", 103, 5000 + chain, None, None, 1, []),
        (8, 10, "assign", 5000, 102, None, None, None, None), (9, 10, "assign", 100, 103, None, None, None, None),
    ]
    instr += [(100 + i, 10, "assign", 5001 + i, 5000 + i, None, None, None, None) for i in range(chain)]
    return Program(
        f([(1, None), (2, 1), (3, 1), (9, None)], schema.CLASS), f(functions, schema.FUNCTION), f([(11, 0, 110), (12, 0, 120)], schema.PARAM), f(instr, schema.INSTR), f([(10,)], schema.ENTRY)
    )


def all_of(made):
    pts = {(r.node, r.heap) for r in made.pts.collect()}
    sizes = sorted(r["size"] for r in made.sizes.collect())
    assert sizes == sorted(sum(m == n for m, _ in pts) for n in {n for n, _ in pts})
    return {(r.instr_id, r.callee) for r in made.calls.collect()}, {(r.src, r.dst) for r in made.edge.collect()}, pts


def test_rounds_of_joins_find_the_same(spark, monkeypatch):
    """With every graph held, with none, and with one that outgrows the bound between two rounds."""
    whole = all_of(pointsto.build(calls_of_calls(spark), CallString(2)))
    assert whole[0] == {(3, 11), (7, 12), (3, 12), (7, 11)}
    for most in (0, 6):
        monkeypatch.setattr(held, "MOST_EDGES", most)
        assert all_of(pointsto.build(calls_of_calls(spark), CallString(2))) == whole


def test_long_chains_take_no_more_jobs(spark, monkeypatch):
    """What flows along 150 assignments takes as many writes as along none."""
    wrote, stored = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, path: wrote.append(path) or stored(df, path))
    for chain in (0, 150):
        wrote.append(None)
        made = pointsto.build(calls_of_calls(spark, chain))
        assert ("V%d" % (5000 + chain), "H4") in {(r.node, r.heap) for r in made.pts.collect()}
    assert wrote.index(None) == 0 and len(wrote) == 2 * wrote.index(None, 1)


def test_rounds_without_new_functions_read_no_body(spark, monkeypatch):
    """Bodies are read when functions are reached: at the start, and when calls are bound to functions not reached before."""
    read, body = [], pointsto.rules.body_edges
    monkeypatch.setattr(pointsto.rules, "body_edges", lambda instr, reach: read.append(1) or body(instr, reach))
    program = calls_of_calls(spark)
    made = pointsto.build(program)
    assert len(read) == 3  # of 10, then of what is called, in two rounds; the last rounds bind calls of known functions
    read.clear()
    program.entries = program.functions.select("fn_id")
    assert all_of(pointsto.build(program)) == all_of(made)
    assert len(read) == 1


def calls_in_turn(spark, deep):
    """Each call's receiver is what the call before it returned, so what calls lead to is found one after the other."""
    f = lambda rows, s: spark.createDataFrame(rows, s)
    functions, instr = [(10, 999, True, 10)], [(1, 10, "alloc", 1000, None, None, 0, None, None)]
    for i in range(deep):
        functions.append((100 + i, i, False, 1))
        instr += [(10 * i + 2, 10, "vcall", 1001 + i, 1000 + i, None, None, 1, []), (10 * i + 3, 100 + i, "alloc", 5000 + i, None, None, i + 1, None, None)]
        instr.append((10 * i + 4, 100 + i, "return", None, 5000 + i, None, None, None, None))
    classes, params = [(i, None) for i in (*range(deep + 1), 999)], [(100 + i, 0, 7000 + i) for i in range(deep)]
    return Program(f(classes, schema.CLASS), f(functions, schema.FUNCTION), f(params, schema.PARAM), f(instr, schema.INSTR), f([(fn,) for fn, *_ in functions], schema.ENTRY))


def test_calls_in_turn_take_two_rounds(spark, monkeypatch):
    """Calls of functions that are reached already open where their kinds are followed."""
    rounds, along = [], pointsto._Kinds.along
    monkeypatch.setattr(pointsto._Kinds, "along", lambda self, *given: rounds.append(1) or along(self, *given))
    made = all_of(pointsto.build(calls_in_turn(spark, 6)))
    assert made[0] == {(10 * i + 2, 100 + i) for i in range(6)}
    assert len(rounds) == 2


def random_program(spark, seed, methods=70):
    """Each class has a method of its own, so there are more kinds than a word has bits."""
    rng, f = random.Random(seed), lambda rows, s: spark.createDataFrame(rows, s)
    functions = [(i, i, False, i % 3) for i in range(1, methods + 1)] + [(100 + i, 999, True, 100 + i) for i in range(6)]
    params = [(fn, pos, fn * 100 + pos) for fn, *_ in functions for pos in range(rng.randrange(4))]
    instr = []
    for fn, *_ in functions:
        var = lambda fn=fn: fn * 100 + rng.randrange(6)
        for kind in (*("alloc",) * (2 if fn < 100 else 9), "assign", "assign", "store", "load", "vcall", "vcall", "vcall", "scall", "return", "return"):
            target = None if kind == "return" or (kind in ("vcall", "scall") and rng.random() < 0.3) else var()
            method = rng.randrange(3) if kind == "vcall" else 100 + rng.randrange(8) if kind == "scall" else None
            args = [var() for _ in range(rng.randrange(3))] if kind in ("vcall", "scall") else None
            instr.append((len(instr), fn, kind, target, None if kind in ("alloc", "scall") else var(), rng.randrange(2) if kind in ("store", "load") else None, 1 + rng.randrange(methods) if kind == "alloc" else None, method, args))
    classes = [(i, i // 2 or None) for i in range(1, methods + 1)] + [(999, None)]
    return Program(f(classes, schema.CLASS), f(functions, schema.FUNCTION), f(params, schema.PARAM), f(instr, schema.INSTR), f([(fn,) for fn, *_ in functions if fn % 3 == 1], schema.ENTRY))


def test_calls_that_open_are_those_of_rounds(spark, monkeypatch):
    program = random_program(spark, 1)
    whole = all_of(pointsto.build(program, CallString(1)))
    assert len(whole[0]) > 100
    monkeypatch.setattr(held, "MOST_EDGES", 0)
    assert all_of(pointsto.build(program, CallString(1))) == whole


def test_edges_of_statements_resolve_no_methods_again(spark, monkeypatch):
    seen, ancestors = [], hierarchy.ancestors
    monkeypatch.setattr(hierarchy, "ancestors", lambda classes: seen.append(1) or ancestors(classes))
    program = calls_of_calls(spark)
    made = pointsto.build(program)
    found = changes.affected_edges(program, made, program.instr.where("kind = 'assign'")).collect()
    assert {tuple(r) for r in found} == {(8, "V102", "V5000"), (9, "V103", "V100")}
    assert len(seen) == 1


def test_edges_of_kinds_are_those_of_the_graph(spark):
    """Functions that are reached over virtual calls alone, or not at all, need the analysis; so do variables of theirs."""
    program = random_program(spark, 2, 4)
    more = spark.createDataFrame([(900, 4000, "assign", 101, 102, None, None, None, None), (901, 4000, "assign", 4001, 4002, None, None, None, None), (902, 1, "assign", None, 102, None, None, None, None)], schema.INSTR)
    program.instr = storage.written(program.instr.unionByName(more), "instr")
    made = pointsto.build(program)
    for kind in ("assign", "scall", "vcall"):
        asked, want = [], changes.affected_edges(program, made, program.instr.where(f"kind = '{kind}'"))
        found = changes.edges_of_kind(program, kind, lambda: asked.append(1) or made)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
        assert asked == [1]


def test_edges_of_entries_need_no_analysis(spark, monkeypatch):
    """Where all functions are entries, or reached over static calls, virtual calls need not be bound."""
    program = calls_of_calls(spark)
    monkeypatch.setitem(catalog._program.__globals__, "_program", lambda *_: program)
    monkeypatch.setattr(pointsto, "build", None)
    found = catalog.QUERIES["affected_edges_assign"](spark, "")
    assert {tuple(r) for r in found.collect()} == {(8, "V102", "V5000"), (9, "V103", "V100")}
