"""Programs without what stays inside their functions, against whole ones; static calls in one task against brute force."""

import random

import pyarrow as pa
import pytest

from pointweave import schema
from pointweave.functions.context import CallString, NoContext
from pointweave.operators import entered, stats
from pointweave.plans import outline, pointsto
from pointweave.program import Program


def random_program(spark, seed=3):
    """Some variables are several functions', one function allocates more than 64 times, some operands are null."""
    rng, f = random.Random(seed), lambda rows, s: spark.createDataFrame(rows, s)
    ids, instr = list(range(1, 13)), []
    functions = [(i, i % 3 + 1, i % 2 == 0, i if i % 2 == 0 else i % 5) for i in ids]
    for fn in ids:
        var = lambda fn=fn: rng.randrange(3) + 9000 if rng.random() < 0.05 else fn * 100 + rng.randrange(9)
        for kind in rng.choices(schema.KINDS, k=22) + (["alloc"] * 80 if fn == 5 else []):
            call = kind in ("scall", "vcall")
            instr.append((
                len(instr) + 1, fn, kind, None if kind == "return" or call and rng.random() < 0.3 else var(), None if kind in ("alloc", "scall") else var(), rng.randrange(2),
                rng.randrange(1, 6) if kind == "alloc" else None, rng.choice([2, 4, 6, 8]) if kind == "scall" else rng.randrange(5) if kind == "vcall" else None, [var(), var()] if call else None,
            ))
    params = [(i, p, i * 100 + p) for i in ids for p in (0, 1)]
    return Program(
        f([(1, None), (2, 1), (3, 1), (4, 2), (5, 3)], schema.CLASS), f(functions, schema.FUNCTION), f(params, schema.PARAM), f(instr, schema.INSTR), f([(i,) for i in ids[:9]], schema.ENTRY)
    )


@pytest.mark.parametrize("policy, profile", [(NoContext(), "reference"), (CallString(2), "corrected"), (CallString(2), "reference")])
def test_outline_has_the_same_reach_and_sizes(spark, policy, profile):
    program = random_program(spark)
    whole, small = pointsto.build(program, policy, profile), outline.build(program, policy, profile)
    pairs = lambda made: {(r.fn_id, tuple(r.ctx)) for r in made.reach.collect()}
    assert pairs(small) == pairs(whole)
    assert small.summed.collect() == stats.summed(whole.sizes).collect()
    assert small.made.edge.count() < whole.edge.count()


@pytest.mark.parametrize("keep", [0, 1, 2])
def test_static_calls_in_one_task(keep):
    rng = random.Random(keep)
    sites = list({(rng.randrange(30), m, m + 1) for m in rng.choices(range(40), k=60)})
    start, known = [(1, [7][:keep]), (2, [])], [(3, [5, 6][:keep])]
    rows = [(f, c, 0, None) for f, c in start] + [(f, c, 1, None) for f, c in known] + [(f, [m], 2, g) for f, m, g in sites]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64()))]
    got = [(r["fn_id"], tuple(r["ctx"])) for b in entered.closed(pa.table(columns, ["fn_id", "ctx", "what", "callee"]), keep) for r in b.to_pylist()]
    seen = {(f, tuple(c)) for f, c in known}
    want, work = set(), [(f, tuple(c)) for f, c in start]
    while work:
        if (job := work.pop()) not in seen:
            seen.add(job)
            want.add(job)
            work += [(g, (*job[1], m)[-keep:] if keep else ()) for f, m, g in sites if f == job[0]]
    assert len(got) == len(set(got)) and set(got) == want
