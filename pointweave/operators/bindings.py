"""Virtual calls that open while kinds of classes are followed in a held graph.

A task that follows kinds binds the call sites whose receivers they reach and goes on along the arguments' and results'
edges, so that most rounds of the build are one task's. Only edges that the build will add are opened: those of sites and
callees that are reached already, between nodes that have numbers. What is left out (callees not reached before, or bound
by what another task follows) the build's next round finds; it ends only when a round finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.context import label, variable
from pointweave.storage import Growing, written


def _expanded(begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of rows, which entry) for every entry of each row; a row's entries are begin[row] to begin[row + 1]."""
    n = begin[rows + 1] - begin[rows]
    return np.repeat(np.arange(len(rows)), n), np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of wanted are among the sorted keys, where these are)."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    hit = np.flatnonzero(keys[at] == wanted) if len(keys) else np.zeros(0, np.int64)
    return hit, at[hit]


@dataclass
class Opening:
    """Call sites and what they may call, by numbers; a node without a number is -1."""

    receiver: np.ndarray  # of each site: node, selector, the callee's context, node of the result
    selector: np.ndarray
    context: np.ndarray
    target: np.ndarray
    arg_begin: np.ndarray  # where each site's arguments begin, the receiver first; their nodes
    arg: np.ndarray
    kinds: np.ndarray  # sorted
    lead_key: np.ndarray  # kind's place * selectors + selector, sorted; the function that they lead to
    lead_fn: np.ndarray
    callee_key: np.ndarray  # function * contexts + context of functions that are reached, sorted
    param_begin: np.ndarray  # where each callee's parameters begin; their positions and nodes
    param_pos: np.ndarray
    param: np.ndarray
    back_begin: np.ndarray  # where each callee's returned variables begin; their nodes
    back: np.ndarray
    selectors: int
    contexts: int

    def opened(self) -> Opened:
        return Opened(self)


class Opened:
    """What one task has bound."""

    def __init__(self, by: Opening):
        self.by, self.bound = by, np.zeros(0, np.int64)

    def start(self, kinds: np.ndarray) -> None:
        """Other kinds, one bit each, are followed from here."""
        self.word = np.zeros(len(self.by.receiver), np.uint64)
        self.some, self.place = _found(self.by.kinds, kinds)

    def edges(self, visited: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """src, dst of calls that open by what visited (a word a node) has more than the last time."""
        by = self.by
        word = np.where(by.receiver >= 0, visited[by.receiver], np.uint64(0))
        new, self.word = word & ~self.word, word
        some = np.flatnonzero(new)
        bits = np.unpackbits(new[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, self.some]
        row, bit = np.nonzero(bits)
        site = some[row]
        hit, at = _found(by.lead_key, self.place[bit] * by.selectors + by.selector[site])
        site, fn = site[hit], by.lead_fn[at]
        hit, callee = _found(by.callee_key, fn * by.contexts + by.context[site])
        calls = np.setdiff1d(site[hit] * max(len(by.callee_key), 1) + callee, self.bound)
        self.bound = np.union1d(self.bound, calls)
        site, callee = np.divmod(calls, max(len(by.callee_key), 1))
        which, at = _expanded(by.param_begin, callee)
        pos, given = by.param_pos[at], by.arg_begin[site[which] + 1] - by.arg_begin[site[which]]
        ok = (pos >= 0) & (pos < given)
        src, dst = by.arg[(by.arg_begin[site[which]] + pos)[ok]], by.param[at[ok]]
        which, at = _expanded(by.back_begin, callee)
        src, dst = np.concatenate([src, by.back[at]]), np.concatenate([dst, by.target[site[which]]])
        ok = (src >= 0) & (dst >= 0)
        return src[ok], dst[ok]


class Callable:
    """What virtual calls connect, of the functions reached so far. labels: node, of all of it."""

    def __init__(self, sites: DataFrame, reach: DataFrame, params: DataFrame, back: DataFrame, leads: DataFrame, policy):
        """leads: kind, selector, fn_id."""
        self.leads = leads
        each = lambda c: F.transform(F.col("args"), lambda a: variable(a, c))
        self.sites = written(sites.select(each(F.col("ctx")).alias("args"), variable(F.col("target"), F.col("ctx")).alias("target"), "selector", label(policy.merge(F.col("ctx"), F.col("selector"))).alias("context")), "open-sites")
        callee = reach.join(leads.select("fn_id").distinct(), "fn_id", "left_semi")
        of = lambda df, pos, var: df.join(callee, "fn_id").select("fn_id", label(F.col("ctx")).alias("context"), pos.cast("bigint").alias("pos"), variable(F.col(var), F.col("ctx")).alias("node"))
        # position -1: a returned variable; -2: the callee itself
        self.callees = written(of(params.where("pos >= 0"), F.col("pos"), "var_id").unionByName(of(back, F.lit(-1), "source")).unionByName(callee.select("fn_id", label(F.col("ctx")).alias("context"), F.lit(-2).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("node"))), "open-callees")
        ends = self.sites.select(F.explode(F.concat("args", F.array("target"))).alias("node")).unionByName(self.callees.select("node"))
        self.labels = written(ends.where("node is not null").distinct(), "open-labels")

    def opening(self, nodes: Growing) -> Opening:
        """By the numbers in nodes (node, id)."""
        ids = nodes.all.join(self.labels, "node").select("node", "id").toArrow()
        number = ids.column("id").to_numpy()

        def numbers(labels) -> np.ndarray:
            at = pc.fill_null(pc.index_in(labels, value_set=ids.column("node")), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            return np.where(at >= 0, number[at], -1) if len(number) else at

        def coded(*columns) -> tuple[list[np.ndarray], np.ndarray]:
            """Values of the same meaning by their places in a sorted list, which is the second part."""
            values = pc.unique(pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type)).sort()
            return [pc.index_in(c, value_set=values).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], values.to_numpy(zero_copy_only=False)

        begins = lambda key, n: np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(key, minlength=n))])
        sites, callees, leads = self.sites.toArrow(), self.callees.toArrow(), self.leads.toArrow()
        (selector, lead_selector), selectors = coded(sites.column("selector"), leads.column("selector"))
        (context, callee_context), contexts = coded(sites.column("context"), callees.column("context"))
        (lead_fn, callee_fn), _ = coded(leads.column("fn_id"), callees.column("fn_id"))
        (kind,), kinds = coded(leads.column("kind"))
        args = sites.column("args").combine_chunks()
        arg_begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.list_value_length(args).to_numpy(zero_copy_only=False).astype(np.int64))])
        arg = numbers(pc.list_flatten(args))
        lead = kind * len(selectors) + lead_selector
        order = np.argsort(lead)
        key, callee = np.unique(callee_fn * len(contexts) + callee_context, return_inverse=True)
        by = np.argsort(callee, kind="stable")
        callee, pos, node = callee[by], callees.column("pos").to_numpy()[by], numbers(callees.column("node"))[by]
        param, back = pos >= 0, pos == -1
        return Opening(
            arg[arg_begin[:-1]], selector, context, numbers(sites.column("target")), arg_begin, arg, kinds, lead[order], lead_fn[order],
            key, begins(callee[param], len(key)), pos[param], node[param], begins(callee[back], len(key)), node[back], len(selectors), len(contexts),
        )
