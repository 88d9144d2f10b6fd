"""Functions and contexts that static calls reach, followed in one task.

A function and its context are one number: the function's, then its context's names, newest last, a few bits each. Entering
a function shifts its name in. There are at most as many results as starts and call sites with different last names, so
call strings of up to two names are bounded by the input; longer ones, larger inputs and names of too many bits go by
rounds of joins (see fixpoint).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.context import CallString, NoContext
from pointweave.operators.held import by_source

#: The most starts, known pairs and call sites that one task takes, and the most names of a context.
MOST_ROWS, MOST_NAMES = 12_000_000, 2
#: Bits of a number.
BITS = 63


def names_kept(policy) -> int | None:
    """How many names a context keeps; None if this module does not know the policy."""
    if isinstance(policy, NoContext):
        return 0
    return max(policy.n, 1) if isinstance(policy, CallString) else None


def reached(start: DataFrame, known: DataFrame | None, sites: DataFrame, n_sites: int, policy) -> DataFrame | None:
    """fn_id, ctx: start (fn_id, ctx) and what sites (fn_id, method, callee) lead to from there, without what is known;
    None if it is not for one task."""
    keep = names_kept(policy)
    if keep is None or keep > MOST_NAMES:
        return None
    rows = start.select("fn_id", "ctx", F.lit(0).alias("what"), F.lit(None).cast("bigint").alias("callee"))
    if known is not None:
        rows = rows.unionByName(known.select("fn_id", "ctx", F.lit(1).alias("what"), F.lit(None).cast("bigint").alias("callee")))
    if rows.count() + n_sites > MOST_ROWS:
        return None
    rows = rows.unionByName(sites.select("fn_id", F.array("method").alias("ctx"), F.lit(2).alias("what"), "callee"))
    functions, names = (sites.select("callee").distinct().count() + rows.select("fn_id").distinct().count()).bit_length(), 0
    if keep:
        names = rows.select(F.explode("ctx").alias("name")).distinct().count().bit_length()
    if functions + keep * names > BITS:
        return None

    def run(batches):
        from pointweave.operators import entered

        batches = list(batches)
        if batches:
            yield from entered.closed(pa.Table.from_batches(batches).combine_chunks(), keep)

    return rows.repartition(1).mapInArrow(run, "fn_id bigint, ctx array<bigint>")


def closed(table: pa.Table, keep: int):
    """From rows fn_id, ctx, what (0 start, 1 known, 2 call site), callee: batches of what is new (fn_id, ctx)."""
    what, fn_id = table.column("what").to_numpy(), table.column("fn_id").to_numpy()
    lists = table.column("ctx").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    named, value = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    begin = np.cumsum(size) - size
    site = what == 2
    callee = table.column("callee").filter(pa.array(site)).to_numpy()
    functions, number = np.unique(np.concatenate([fn_id, callee]), return_inverse=True)
    fn, callee = number[: len(fn_id)], number[len(fn_id) :]
    bits = len(named).bit_length() if keep else 0
    room = keep * bits
    mask = (1 << room) - 1
    context = np.zeros(len(fn), np.int64)  # names from 1; 0 is none
    for i in range(keep):
        has = np.flatnonzero(size > i)
        context[has] = (context[has] << bits) | (value[begin[has] + i] + 1)
    pair = (fn.astype(np.int64) << room) | context
    order = np.argsort(fn[site], kind="stable")
    first, _ = by_source(fn[site], callee, len(functions))
    to, name = callee[order], context[site][order]
    seen = np.unique(pair[what == 1])
    front = np.setdiff1d(pair[what == 0], seen)
    found = [front]
    while len(front):
        seen = np.union1d(seen, front)
        f, c = front >> room, front & mask
        d = first[f + 1] - first[f]
        at = np.repeat(first[f] - (np.cumsum(d) - d), d) + np.arange(int(d.sum()))
        front = np.setdiff1d((to[at].astype(np.int64) << room) | (((np.repeat(c, d) << bits) | name[at]) & mask if keep else 0), seen)
        found.append(front)
    found = np.concatenate(found)
    slots = np.stack([(found >> (bits * (keep - 1 - i))) & ((1 << bits) - 1) for i in range(keep)], axis=1) if keep else np.zeros((len(found), 0), np.int64)
    used = slots > 0
    ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
    ctx = pa.ListArray.from_arrays(pa.array(ends), pa.array(named[slots[used] - 1] if len(named) else np.zeros(0, np.int64), pa.int64()))
    yield from pa.table({"fn_id": pa.array(functions[found >> room], pa.int64()), "ctx": ctx}).to_batches(1 << 16)
