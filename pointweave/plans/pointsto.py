"""From a program to its graph and points-to sets, with calls discovered on the way.

Reachability over static calls, edges, what receivers hold, and bindings of virtual calls depend on one another. Each
outer round takes the (function, context) pairs that are new, closes them over static calls, adds their edges, and binds
the virtual calls by what their receivers hold. It ends when no binding is new, at the least fixpoint, whatever the order.

A binding depends on a heap item's class alone, and on no more of it than which method each selector leads to. So kinds
of classes flow along the edges in these rounds, not heap items: a kind is the least of the classes that lead to the same
methods. The sets of heap items are derived once, from the final edges, when they are asked for.

Graphs that every task can hold (operators.held) are followed there; larger ones by semi-naive rounds of joins.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.context import NoContext, variable
from pointweave.operators import entered, hierarchy, rules, stats, verify
from pointweave.operators.bindings import Callable
from pointweave.operators.fixpoint import along, points_to, semi_naive
from pointweave.operators.held import HeldGraph
from pointweave.program import Program
from pointweave.storage import Growing, written

#: The largest program for the order-bound mode, which runs on the driver.
SINGLE_SHOT_INSTR = 100_000


@dataclass
class Analysis:
    edge: DataFrame  # src, dst
    seed: DataFrame  # node, heap, class_id
    reach: DataFrame  # fn_id, ctx
    calls: DataFrame  # instr_id, ctx, target, args, callee, callee_ctx: bindings of virtual calls
    kinds: DataFrame  # node, class_id: kinds of what receivers hold, and of more nodes perhaps
    profile: str
    policy: object
    graph: HeldGraph | None = None  # the edges, if every task can hold them
    held: DataFrame | None = None  # node, heap, where they are known already

    def _start(self) -> DataFrame:
        """origin, id: heap items, by the numbers of their own nodes, and where they are."""
        ids, found = self.graph.nodes.all, self.seed.select("node", "heap").distinct()
        return found.join(ids, "node").join(ids.toDF("heap", "origin"), "heap").select("origin", "id")

    @cached_property
    def pts(self) -> DataFrame:
        """node, heap."""
        if self.held is not None:
            return self.held
        if self.graph is None:
            return points_to(self.edge, self.seed)
        ids = self.graph.nodes.all
        return self.graph.reached(self._start()).join(ids, "id").join(ids.toDF("heap", "origin"), "origin").select("node", "heap")

    @cached_property
    def sizes(self) -> DataFrame:
        """size of each non-empty set, without the sets where the graph is held."""
        return stats.sizes(self.pts) if self.graph is None else self.graph.sizes(self._start())


def _pairs(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("callee").alias("fn_id"), F.col("callee_ctx").alias("ctx"))


def reachable_functions(program: Program, policy=NoContext()) -> DataFrame:
    """fn_id, ctx reached from the entries over static calls alone."""
    return _reach(program, _start(program, policy), policy)


def reachable_by_hierarchy(program: Program, policy=NoContext()) -> DataFrame:
    """fn_id, ctx reached from the entries over static calls, and over virtual calls bound to every method of the selector."""
    static, resolved = program.static_functions(), program.resolved()

    def step(new: DataFrame) -> DataFrame:
        called = rules.bind_by_hierarchy(rules.virtual_sites(program.instr, new), resolved, policy)
        return _pairs(rules.static_calls(program.instr, new, static, policy)).unionByName(_pairs(called))

    return semi_naive(_start(program, policy), step, "reach-hierarchy")


def _start(program: Program, policy) -> DataFrame:
    return program.functions.join(program.entries, "fn_id", "left_semi").select("fn_id", policy.initial(F.col("name_id")).alias("ctx"))


def _reach(program: Program, start: DataFrame, policy, known: DataFrame | None = None) -> DataFrame:
    found = entered.reached(start, known, *program.static_sites, policy)
    if found is not None:
        return found
    static = program.static_functions()
    return semi_naive(start, lambda new: _pairs(rules.static_calls(program.instr, new, static, policy)), "reach", known)


def build(program: Program, policy=NoContext(), profile: str = "reference", dispatch: str = "fixpoint") -> Analysis:
    """dispatch: "fixpoint", or "single_shot": every call site is bound once, when its function is taken from a first-in
    first-out list, to what its receiver holds at that moment; for small programs."""
    if dispatch == "single_shot":
        return _single_shot(program, policy, profile)
    spark = program.instr.sparkSession
    static, resolved = program.static_functions(), program.resolved()
    back = written(program.instr.where("kind = 'return'").select("fn_id", "kind", "source"), "returns")
    kind_of = written(hierarchy.kinds(resolved), "kinds")
    edge = Growing(spark, "edge", "src string, dst string")
    seed, reach = Growing(spark, "seed", "node string, heap string, class_id bigint"), Growing(spark, "reach", "fn_id bigint, ctx array<bigint>")
    calls = Growing(spark, "calls", "instr_id bigint, ctx array<bigint>, target bigint, args array<bigint>, callee bigint, callee_ctx array<bigint>")
    flow = _Kinds(spark, kind_of.select("kind").distinct().count())
    leads = written(resolved.join(kind_of.where("class_id = kind"), "class_id").select("kind", "selector", "fn_id"), "leads")
    sites = Growing(spark, "site", "instr_id bigint, ctx array<bigint>, receiver string, selector bigint, target bigint, args array<bigint>")
    new_reach, new_calls, kinds = _start(program, policy), None, None
    while True:
        made = []
        if new_reach is not None:
            new_reach, _ = reach.add(_reach(program, new_reach, policy, reach.all if reach.parts else None))
            called = rules.static_calls(program.instr, new_reach, static, policy)
            made += [
                rules.body_edges(program.instr, new_reach),
                rules.static_argument_edges(called, program.params, profile),
                rules.static_return_edges(called, back, profile),
            ]
            new_seed, _ = seed.add(rules.alloc_seeds(program.instr, new_reach).distinct())
            new_sites, _ = sites.add(rules.virtual_sites(program.instr, new_reach))
            flow.begin(new_seed.join(kind_of, "class_id").select("node", "kind").distinct(), new_sites)
            if flow.graph:
                flow.calls = Callable(sites.all, reach.all, program.params, back, leads, policy)
        if new_calls is not None:
            made += [rules.virtual_argument_edges(new_calls, program.params), rules.virtual_return_edges(new_calls, back)]
        new_edge, n = _new_edges(edge, reduce(DataFrame.unionByName, made))
        if n or new_reach is not None:
            kinds = flow.along(new_edge, edge)
        bound = rules.bind(sites.all, kinds, resolved, policy)
        new_calls, n = calls.add(bound.join(calls.all.select("instr_id", "ctx", "callee"), ["instr_id", "ctx", "callee"], "left_anti") if calls.parts else bound)
        if not n:
            made = Analysis(edge.all, seed.all, reach.all, calls.all, kinds, profile, policy, flow.graph)
            return _checked(made, program)
        new_reach = written(_pairs(new_calls).distinct().join(reach.all, ["fn_id", "ctx"], "left_anti"), "reach-new")
        if new_reach.isEmpty():
            new_reach = None


def _new_edges(edge: Growing, made: DataFrame) -> tuple[DataFrame, int]:
    """Adds the edges in made that edge does not have. Later rounds make few, which look for themselves among the many."""
    made = made.distinct()
    if edge.parts:
        made = written(made, "edge-made")
        known = edge.all.join(made, ["src", "dst"], "left_semi")
        made = made.join(written(known, "edge-known"), ["src", "dst"], "left_anti")
    return edge.add(made)


class _Kinds:
    """The kinds of classes that flow along the edges so far."""

    def __init__(self, spark, n: int):
        self.graph: HeldGraph | None = HeldGraph(spark)
        self.tasks = max(1, -(-n // 64))  # 64 kinds are followed at once
        self.seed, self.all = Growing(spark, "kind-seed", "node string, kind bigint"), Growing(spark, "kind", "node string, kind bigint")
        self.start, self.receivers = Growing(spark, "kind-start", "origin bigint, id bigint"), Growing(spark, "receiver", "node string")
        self.met = Growing(spark, "receiver-id", "node string, id bigint")  # receivers that are nodes of the held graph
        self.wanted = np.zeros(0, bool)  # which of its nodes they are
        self.new_seed = self.new_receivers = self.calls = self.opening = None

    def begin(self, new_seed: DataFrame, new_sites: DataFrame) -> None:
        """Takes the seeds (node, kind) and call sites of newly reached functions."""
        self.new_seed, _ = self.seed.add(new_seed)
        self.new_receivers = written(new_sites.select(F.col("receiver").alias("node")).distinct().join(self.receivers.all, "node", "left_anti"), "receiver-new")

    def _meet(self, met: DataFrame) -> None:
        """Takes the numbers of receivers (node, id)."""
        more, _ = self.met.add(met)
        self.wanted = np.concatenate([self.wanted, np.zeros(self.graph.n - len(self.wanted), bool)])
        self.wanted[more.select("id").toArrow().column("id").to_numpy()] = True

    def along(self, new_edge: DataFrame, edge: Growing) -> DataFrame:
        """node, class_id (the kind) of the receivers at least, with the new edges (edge has them) and what begin() took."""
        was, new_seed, self.new_seed, new_receivers, self.new_receivers = self.graph, self.new_seed, None, self.new_receivers, None
        self.graph = was.add(new_edge, self.calls.labels if new_seed is not None else None) if was else None
        if self.graph:
            if new_seed is not None:
                self.opening = self.graph.spark.sparkContext.broadcast(self.calls.opening(self.graph.nodes))
            ids = self.graph.nodes.all
            if self.receivers.parts and self.graph.n > len(self.wanted):
                self._meet(self.receivers.all.join(self.graph.fresh, "node"))
            if new_seed is not None:  # an allocation's edge comes with its seed, so its node has a number
                self.start.add(new_seed.join(ids, "node").select(F.col("kind").alias("origin"), "id"))
                self.receivers.add(new_receivers)
                self._meet(new_receivers.join(ids, "node"))
            found = self.graph.reached(self.start.all, self.wanted, self.tasks, self.opening)
            return written(found.join(self.met.all, "id").select("node", F.col("origin").alias("class_id")), "kinds")
        old = self.all.all
        # kinds that were followed in a held graph are followed anew by joins
        start = self.seed.all if was else new_edge.join(old, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "kind")
        if not was and new_seed is not None:
            start = start.unionByName(new_seed)
        step = along(edge.all, "kind")
        self.all.add(semi_naive(start, step, "kind-new", old))
        return self.all.all.withColumnRenamed("kind", "class_id")


def _checked(made: Analysis, program: Program) -> Analysis:
    """The analysis, looked through if POINTWEAVE_VERIFY asks for it: sets are the unions of what comes in, and no call
    leaves out parameters."""
    if verify.level() >= 1:
        if not verify.union_violations(made.edge, made.seed, made.pts).isEmpty():
            raise RuntimeError("points-to sets are not the unions of their predecessors' sets")
    if verify.level() >= 2:
        sized = made.calls.select("instr_id", F.col("callee").alias("fn_id"), F.size("args").cast("bigint").alias("n_args"))
        if not hierarchy.arity_errors(sized, program.params).isEmpty():
            raise RuntimeError("a virtual call passes fewer arguments than its callee takes")
    return made


def _single_shot(program: Program, policy, profile: str) -> Analysis:
    """The order-bound mode, on the driver: contexts are merged here as the policy's columns would."""
    spark = program.instr.sparkSession
    if program.instr.limit(SINGLE_SHOT_INSTR + 1).count() > SINGLE_SHOT_INSTR:
        raise ValueError(f"single_shot is for programs of up to {SINGLE_SHOT_INSTR} instructions")
    keep = 0 if isinstance(policy, NoContext) else max(policy.n, 1)
    merge = lambda ctx, name: (*ctx, name)[-keep:] if keep else ()
    label = lambda kind, name, ctx: f"{kind}{name}" + (f"@{'.'.join(map(str, ctx))}" if ctx else "")
    functions = {r.fn_id: r for r in program.functions.collect()}
    static = {r.method: r.fn_id for r in program.static_functions().collect()}
    resolved = {(r.class_id, r.selector): r.fn_id for r in program.resolved().collect()}
    params: dict[int, list[int]] = {}
    for r in program.params.orderBy("fn_id", "pos").collect():
        params.setdefault(r.fn_id, []).append(r.var_id)
    body: dict[int, list] = {}
    for r in program.instr.orderBy("instr_id").collect():
        body.setdefault(r.fn_id, []).append(r)
    returned = {f: [i.source for i in b if i.kind == "return"] for f, b in body.items()}
    out: dict[str, dict] = {}
    held: dict[str, set] = {}
    seeds, calls = {}, []

    def push(node: str, heaps: set) -> None:
        work = [(node, heaps)]
        while work:
            n, hs = work.pop()
            if fresh := hs - held.setdefault(n, set()):
                held[n] |= fresh
                work += [(m, fresh) for m in out.get(n, ())]

    def add(a: str, b: str) -> None:
        if b not in out.setdefault(a, {}):
            out[a][b] = True
            push(b, set(held.get(a, ())))

    entries = sorted(r.fn_id for r in program.entries.collect() if r.fn_id in functions)
    work = deque((f, (functions[f].name_id,)[:1] if keep else ()) for f in entries)
    seen, reach = set(), {}
    while work:
        f, ctx = work.popleft()
        reach[f, ctx] = True
        var = lambda v, c=ctx: label("V", v, c)
        for i in body.get(f, ()):
            if i.kind == "alloc":
                h = label("H", i.instr_id, ctx)
                seeds[h] = i.class_id
                push(h, {h})
                add(h, var(i.target))
            elif i.kind == "assign":
                add(var(i.source), var(i.target))
            elif i.kind == "store":
                add(var(i.source), label("F", f"{i.target}.{i.field}", ctx))
            elif i.kind == "load":
                add(label("F", f"{i.source}.{i.field}", ctx), var(i.target))
            elif i.kind == "scall" and (g := static.get(i.method)) is not None:
                inner = ctx if profile == "reference" else merge(ctx, i.method)
                for a, p in zip(i.args or (), params.get(g, ())):
                    add(var(a), label("V", p, inner))
                for z in returned.get(g, ()) if i.target is not None else ():
                    add(*((var(i.target), label("V", z, ctx)) if profile == "reference" else (label("V", z, inner), var(i.target))))
        for i in body.get(f, ()):
            if i.kind == "scall" and (g := static.get(i.method)) is not None:
                job = (g, merge(ctx, i.method))
                if job not in seen:
                    seen.add(job)
                    work.append(job)
            elif i.kind == "vcall":
                for h in sorted(held.get(var(i.source), ())):
                    if (g := resolved.get((seeds[h], i.method))) is None:
                        continue
                    inner, args = merge(ctx, i.method), [i.source, *(i.args or ())]
                    calls.append((i.instr_id, list(ctx), i.target, args, g, list(inner)))
                    for a, p in zip(args, params.get(g, ())):
                        add(var(a), label("V", p, inner))
                    for z in returned.get(g, ()) if i.target is not None else ():
                        add(label("V", z, inner), var(i.target))
                    if (g, inner) not in seen:
                        seen.add((g, inner))
                        work.append((g, inner))
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    return Analysis(
        frame([(a, b) for a, bs in out.items() for b in bs], "src string, dst string"),
        frame([(h, h, c) for h, c in seeds.items()], "node string, heap string, class_id bigint"),
        frame([(f, list(c)) for f, c in reach], "fn_id bigint, ctx array<bigint>"),
        frame(calls, "instr_id bigint, ctx array<bigint>, target bigint, args array<bigint>, callee bigint, callee_ctx array<bigint>").distinct(),
        frame([(n, c) for n, hs in held.items() for c in {seeds[h] for h in hs}], "node string, class_id bigint"),
        profile, policy, held=frame([(n, h) for n, hs in held.items() for h in hs], "node string, heap string"),
    )


def contexts_of_nodes(program: Program, analysis: Analysis) -> DataFrame:
    """var_id, ctx: the contexts in which each variable has a node."""
    edge = analysis.edge.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    used = program.instr.select("fn_id", F.explode(F.array_compact(F.array("target", "source"))).alias("var_id")).unionByName(program.params.select("fn_id", "var_id")).distinct()
    return used.join(analysis.reach, "fn_id").select("var_id", "ctx", variable(F.col("var_id"), F.col("ctx")).alias("node")).join(edge, "node", "left_semi").select("var_id", "ctx").distinct()
