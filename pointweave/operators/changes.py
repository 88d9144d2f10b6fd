"""From changed statements to the edges that they stand for.

Candidates are pairs of nodes without contexts; those that are edges in some contexts are the statement's change set.
Joining candidates with the edges by their bases is the same as crossing the contexts and filtering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.context import NoContext, field, heap, variable
from pointweave.operators import rules
from pointweave.plans.pointsto import Analysis, reachable_functions
from pointweave.program import Program


def _none():
    return F.array().cast("array<bigint>")


def _var(column: str):
    return variable(F.col(column), _none())


def _pair(df: DataFrame, src, dst) -> DataFrame:
    return df.select("instr_id", src.alias("src_base"), dst.alias("dst_base"))


def candidates(program: Program, analysis: Analysis, instr: DataFrame) -> DataFrame:
    """instr_id, src_base, dst_base for the instructions in instr. Returns stand for no edge of their own."""
    out = _without_bindings(program, instr, analysis.profile)
    every = analysis.reach.select("fn_id", "ctx")
    sites = rules.virtual_sites(instr.where("kind = 'vcall'"), every)
    bound = rules.bind(sites, analysis.kinds, program.resolved(), NoContext())
    return out.unionByName(_call(bound.select("instr_id", "target", "args", "callee").distinct(), program, analysis.profile)).distinct()


def _without_bindings(program: Program, instr: DataFrame, profile: str) -> DataFrame:
    """The candidates of all but virtual calls, not yet distinct."""
    of = lambda kind: instr.where(F.col("kind") == kind)
    out = _pair(of("assign"), _var("source"), _var("target"))
    out = out.unionByName(_pair(of("alloc"), heap(F.col("instr_id"), _none()), _var("target")))
    out = out.unionByName(_pair(of("store"), _var("source"), field(F.col("target"), F.col("field"), _none())))
    out = out.unionByName(_pair(of("load"), field(F.col("source"), F.col("field"), _none()), _var("target")))
    static = program.static_functions().select("method", F.col("fn_id").alias("callee"))
    called = of("scall").join(static, "method").select("instr_id", "target", "args", "callee")
    return out.unionByName(_call(called, program, "reference" if profile == "reference" else "corrected"))


def _call(calls: DataFrame, program: Program, profile: str) -> DataFrame:
    each = calls.select("instr_id", "callee", F.posexplode("args").alias("pos", "arg")).join(program.params.select(F.col("fn_id").alias("callee"), "pos", "var_id"), ["callee", "pos"])
    back = calls.where("target is not null").join(program.returns().select(F.col("fn_id").alias("callee"), F.col("var_id").alias("returned")), "callee")
    ends = (_var("target"), _var("returned")) if profile == "reference" else (_var("returned"), _var("target"))
    return _pair(each, _var("arg"), _var("var_id")).unionByName(_pair(back, *ends))


def affected_edges(program: Program, analysis: Analysis, instr: DataFrame) -> DataFrame:
    """instr_id, src, dst: the edges in the graph that the instructions stand for."""
    base = lambda c: F.substring_index(F.col(c), "@", 1)
    edge = analysis.edge.select("src", "dst", base("src").alias("src_base"), base("dst").alias("dst_base"))
    return candidates(program, analysis, instr).join(edge, ["src_base", "dst_base"]).select("instr_id", "src", "dst").distinct()


def edges_of_kind(program: Program, kind: str, analysis: Callable[[], Analysis], profile: str = "reference") -> DataFrame:
    """affected_edges() of the program's own instructions of a kind, without contexts.

    What a reached function's statement stands for is in the graph, whatever virtual calls lead to; theirs apart. So the
    analysis is asked for only if some of the functions are neither entries nor reached over static calls."""
    instr = program.instr.where(F.col("kind") == kind)
    if kind == "vcall":
        return affected_edges(program, analysis(), instr)
    found = lambda of: _without_bindings(program, of, profile).select("instr_id", F.col("src_base").alias("src"), F.col("dst_base").alias("dst")).where("src is not null and dst is not null").distinct()
    reached = program.functions.join(program.entries, "fn_id", "left_semi").select("fn_id")
    if instr.join(reached, "fn_id", "left_anti").isEmpty():
        return found(instr)
    reached = reachable_functions(program).select("fn_id")
    if (rest := instr.join(reached, "fn_id", "left_anti")).isEmpty():
        return found(instr)
    return found(instr.join(reached, "fn_id", "left_semi")).unionByName(affected_edges(program, analysis(), rest))
