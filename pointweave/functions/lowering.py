"""Lowering of instructions in SSA form to the seven instruction kinds, as projections and filters.

Input as in schema.SSA. Output: fn_id, pos, kind, target, source, field, type_name, method, args; variables are named
by function and value number, static fields and tokens by a name of their own, shared by all functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pseudo-field that stands for all elements of all arrays.
ARRAY_FIELD = "array"
#: Methods whose special invocations are bound statically.
CONSTRUCTORS = ("<init>", "<clinit>")

COLUMNS = ("fn_id", "pos", "kind", "target", "source", "field", "type_name", "method", "args")


def value(number: Column) -> Column:
    return F.when(number.isNotNull(), F.concat(F.col("fn_id").cast("string"), F.lit("#"), number.cast("string")))


def _use(i: int) -> Column:
    return value(F.get("uses", F.lit(i)))


def _values(uses: Column) -> Column:
    return F.transform(uses, lambda u: F.concat(F.col("fn_id").cast("string"), F.lit("#"), u.cast("string")))


def _row(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    kinds = dict.fromkeys(COLUMNS, "string") | {"args": "array<string>"}
    made = {"kind": F.lit(kind), "fn_id": F.col("fn_id"), "pos": F.col("pos"), **columns}
    return df.select(*(made[c].alias(c) if c in ("fn_id", "pos", "kind") else made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS))


def is_virtual() -> Column:
    """Dispatched calls, and special ones of anything but a constructor."""
    special = F.col("is_special")
    for name in CONSTRUCTORS:
        special = special & ~F.contains(F.col("signature"), F.lit(name))
    return F.coalesce(F.col("is_dispatch") | special, F.lit(False))


def array_loads(ssa: DataFrame) -> DataFrame:
    return _row(ssa.where("op = 'array_load' and not is_primitive"), "load", target=value(F.col("def_id")), source=_use(0), field=F.lit(ARRAY_FIELD))


def array_stores(ssa: DataFrame) -> DataFrame:
    return _row(ssa.where("op = 'array_store' and not is_primitive"), "store", target=_use(0), field=F.lit(ARRAY_FIELD), source=_use(1))


def returns(ssa: DataFrame) -> DataFrame:
    return _row(ssa.where("op = 'return' and not is_primitive and size(uses) > 0"), "return", source=_use(0))


def virtual_calls(ssa: DataFrame) -> DataFrame:
    rest = F.slice("uses", F.lit(2), F.greatest(F.size("uses") - 1, F.lit(0)))
    return _row(ssa.where("op = 'invoke'").where(is_virtual()), "vcall", target=value(F.col("def_id")), source=_use(0), method=F.col("selector"), args=_values(rest))


def static_calls(ssa: DataFrame) -> DataFrame:
    """Static calls and constructors, whose receiver is their first argument."""
    return _row(ssa.where("op = 'invoke'").where(~is_virtual()), "scall", target=value(F.col("def_id")), method=F.col("signature"), args=_values(F.col("uses")))


def static_field() -> Column:
    return F.concat(F.lit("static:"), F.col("field"))


def get_fields(ssa: DataFrame) -> DataFrame:
    got = ssa.where("op = 'get_field'")
    return _row(got.where("is_static"), "assign", target=value(F.col("def_id")), source=static_field()).unionByName(
        _row(got.where("not is_static"), "load", target=value(F.col("def_id")), source=_use(0), field=F.col("field"))
    )


def put_fields(ssa: DataFrame) -> DataFrame:
    put = ssa.where("op = 'put_field'")
    return _row(put.where("is_static"), "assign", target=static_field(), source=_use(0)).unionByName(
        _row(put.where("not is_static"), "store", target=_use(0), field=F.col("field"), source=_use(1))
    )


def casts(ssa: DataFrame) -> DataFrame:
    """Check-casts and pi nodes copy their value; the type is not used."""
    return _row(ssa.where("op in ('check_cast', 'pi')"), "assign", target=value(F.col("def_id")), source=_use(0))


def phis(ssa: DataFrame) -> DataFrame:
    """One assignment for each use."""
    each = ssa.where("op = 'phi'").withColumn("_use", F.explode("uses"))
    return _row(each, "assign", target=value(F.col("def_id")), source=value(F.col("_use")))


def allocations(ssa: DataFrame, types: DataFrame) -> DataFrame:
    """Allocations of known types (type_name)."""
    return _row(ssa.where("op = 'new'").join(types.select("type_name").distinct(), "type_name", "left_semi"), "alloc", target=value(F.col("def_id")), type_name=F.col("type_name"))


def metadata(ssa: DataFrame) -> DataFrame:
    return _row(ssa.where("op = 'metadata'"), "assign", target=value(F.col("def_id")), source=F.concat(F.lit("tok:"), F.col("token")))


def lower(ssa: DataFrame, types: DataFrame) -> DataFrame:
    """All of the above; operations of other kinds give nothing."""
    parts = [array_loads(ssa), array_stores(ssa), returns(ssa), virtual_calls(ssa), static_calls(ssa), get_fields(ssa), put_fields(ssa), casts(ssa), phis(ssa), allocations(ssa, types), metadata(ssa)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lower_functions(functions: DataFrame) -> DataFrame:
    """fn_id, name, is_static from functions (fn_id, signature, selector, static_flag): constructors are static; static
    functions go by their signature, others by their selector."""
    static = F.col("static_flag")
    for name in CONSTRUCTORS:
        static = static | F.contains(F.col("signature"), F.lit(name))
    return functions.select("fn_id", F.when(static, F.col("signature")).otherwise(F.col("selector")).alias("name"), static.alias("is_static"))


def parameters(functions: DataFrame) -> DataFrame:
    """fn_id, pos, ssa, name from functions (fn_id, signature, n_params): parameter i is SSA value i + 1."""
    return functions.where("n_params > 0").select("fn_id", "signature", F.explode(F.sequence(F.lit(0), F.col("n_params").cast("int") - 1)).alias("pos")).select(
        "fn_id", "pos", (F.col("pos") + 1).alias("ssa"), F.concat("signature", F.lit("::param"), F.col("pos").cast("string")).alias("name")
    )
