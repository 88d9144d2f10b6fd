"""Graph-construction rules: from program facts and reachable (function, context) pairs to edges and seeds.

Every rule is a projection of the instructions of reachable functions, joined with parameters and returns for calls.
reach: fn_id, ctx. The result of an edge rule is src, dst (labels as in functions.context), not yet distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.context import field, heap, variable


def _of(instr: DataFrame, kind: str, reach: DataFrame) -> DataFrame:
    return instr.where(F.col("kind") == kind).join(reach, "fn_id")


def alloc_edges(instr: DataFrame, reach: DataFrame) -> DataFrame:
    """x = new O: the heap item flows to x."""
    return _of(instr, "alloc", reach).select(heap(F.col("instr_id"), F.col("ctx")).alias("src"), variable(F.col("target"), F.col("ctx")).alias("dst"))


def alloc_seeds(instr: DataFrame, reach: DataFrame) -> DataFrame:
    """node, heap, class_id: a heap item holds itself."""
    return _of(instr, "alloc", reach).select(heap(F.col("instr_id"), F.col("ctx")).alias("node"), heap(F.col("instr_id"), F.col("ctx")).alias("heap"), "class_id")


def assign_edges(instr: DataFrame, reach: DataFrame) -> DataFrame:
    """x = y."""
    return _of(instr, "assign", reach).select(variable(F.col("source"), F.col("ctx")).alias("src"), variable(F.col("target"), F.col("ctx")).alias("dst"))


def load_edges(instr: DataFrame, reach: DataFrame) -> DataFrame:
    """x = y.f: from the field of y to x."""
    return _of(instr, "load", reach).select(field(F.col("source"), F.col("field"), F.col("ctx")).alias("src"), variable(F.col("target"), F.col("ctx")).alias("dst"))


def store_edges(instr: DataFrame, reach: DataFrame) -> DataFrame:
    """x.f = y: from y to the field of x."""
    return _of(instr, "store", reach).select(variable(F.col("source"), F.col("ctx")).alias("src"), field(F.col("target"), F.col("field"), F.col("ctx")).alias("dst"))


def static_calls(instr: DataFrame, reach: DataFrame, static: DataFrame, policy) -> DataFrame:
    """instr_id, ctx, target, args, callee, callee_ctx of static calls whose callee is known; static: method, fn_id."""
    called = static.select("method", F.col("fn_id").alias("callee"))
    return _of(instr, "scall", reach).join(called, "method").select("instr_id", "ctx", "target", "args", "callee", policy.merge(F.col("ctx"), F.col("method")).alias("callee_ctx"))


def argument_edges(calls: DataFrame, param: DataFrame, bound_in: str) -> DataFrame:
    """Arguments flow to the parameters of the same position; surplus ones of either side are left out. bound_in: the
    column with the context in which parameters are bound."""
    each = calls.select("ctx", "callee", F.col(bound_in).alias("_bound"), F.posexplode("args").alias("pos", "arg")).where("arg is not null")
    bound = each.join(param.select(F.col("fn_id").alias("callee"), "pos", "var_id"), ["callee", "pos"])
    return bound.select(variable(F.col("arg"), F.col("ctx")).alias("src"), variable(F.col("var_id"), F.col("_bound")).alias("dst"))


def _returned(calls: DataFrame, instr: DataFrame) -> DataFrame:
    back = instr.where("kind = 'return'").select(F.col("fn_id").alias("callee"), F.col("source").alias("returned"))
    return calls.where("target is not null").join(back, "callee")


def static_argument_edges(calls: DataFrame, param: DataFrame, profile: str = "reference") -> DataFrame:
    return argument_edges(calls, param, "ctx" if profile == "reference" else "callee_ctx")


def static_return_edges(calls: DataFrame, instr: DataFrame, profile: str = "reference") -> DataFrame:
    found = _returned(calls, instr)
    if profile == "reference":
        return found.select(variable(F.col("target"), F.col("ctx")).alias("src"), variable(F.col("returned"), F.col("ctx")).alias("dst"))
    return found.select(variable(F.col("returned"), F.col("callee_ctx")).alias("src"), variable(F.col("target"), F.col("ctx")).alias("dst"))


def virtual_sites(instr: DataFrame, reach: DataFrame) -> DataFrame:
    """instr_id, ctx, receiver (label), selector, target, args with the receiver first."""
    return _of(instr, "vcall", reach).select(
        "instr_id", "ctx", variable(F.col("source"), F.col("ctx")).alias("receiver"), F.col("method").alias("selector"), "target", F.concat(F.array("source"), F.coalesce("args", F.array().cast("array<bigint>"))).alias("args")
    )


def bind(sites: DataFrame, kinds: DataFrame, resolved: DataFrame, policy) -> DataFrame:
    """Virtual calls with the methods that the classes of what the receiver holds lead to; kinds: node, class_id."""
    met = sites.join(kinds, F.col("receiver") == F.col("node")).join(resolved.withColumnRenamed("fn_id", "callee"), ["class_id", "selector"])
    return met.select("instr_id", "ctx", "target", "args", "callee", policy.merge(F.col("ctx"), F.col("selector")).alias("callee_ctx")).distinct()


def bind_by_hierarchy(sites: DataFrame, resolved: DataFrame, policy) -> DataFrame:
    """Virtual calls with every method that some class has for the selector."""
    by = resolved.select("selector", F.col("fn_id").alias("callee")).distinct()
    return sites.join(by, "selector").select("instr_id", "ctx", "target", "args", "callee", policy.merge(F.col("ctx"), F.col("selector")).alias("callee_ctx"))


def virtual_argument_edges(calls: DataFrame, param: DataFrame) -> DataFrame:
    return argument_edges(calls, param, "callee_ctx")


def virtual_return_edges(calls: DataFrame, instr: DataFrame) -> DataFrame:
    return _returned(calls, instr).select(variable(F.col("returned"), F.col("callee_ctx")).alias("src"), variable(F.col("target"), F.col("ctx")).alias("dst"))


def body_edges(instr: DataFrame, reach: DataFrame) -> DataFrame:
    """Edges of all rules that need no call."""
    return alloc_edges(instr, reach).unionByName(assign_edges(instr, reach)).unionByName(load_edges(instr, reach)).unionByName(store_edges(instr, reach))
