"""The relations of the engine. All are unordered sets of rows; ids are surrogate keys.

edge       src, dst                      directed, distinct; a self-edge is allowed
seed       node, heap                    what a node holds by itself
pts        node, heap                    what a node may point to
scc        node, rep                     component; rep is its least node
change     seq, op (add or del), src, dst   of one edge the last change counts
"""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

#: The seven instruction kinds, in the order of their numbers from 1.
KINDS = ("alloc", "assign", "store", "load", "scall", "vcall", "return")

#: Rule profiles. "reference" keeps two traits of the analysis this engine answers to: results of static calls flow from
#: the call's target to the callee's returned variable, and static calls bind parameters in the caller's context.
#: "corrected" turns the first around and binds in the callee's context.
PROFILES = ("reference", "corrected")


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, null) for name, kind, null in fields])


_L, _S, _B, _I = LongType(), StringType(), BooleanType(), IntegerType()

CLASS = _struct(("class_id", _L, False), ("super_id", _L, True))
FUNCTION = _struct(("fn_id", _L, False), ("class_id", _L, True), ("is_static", _B, False), ("name_id", _L, False))
PARAM = _struct(("fn_id", _L, False), ("pos", _I, False), ("var_id", _L, False))
INSTR = _struct(
    ("instr_id", _L, False), ("fn_id", _L, False), ("kind", _S, False), ("target", _L, True), ("source", _L, True), ("field", _L, True), ("class_id", _L, True),
    ("method", _L, True), ("args", ArrayType(_L), True),
)
ENTRY = _struct(("fn_id", _L, False))
#: Input of the lowering: instructions in static single assignment form, values numbered within their function.
SSA = _struct(
    ("fn_id", _L, False), ("pos", _I, False), ("op", _S, False), ("def_id", _L, True), ("uses", ArrayType(_L), True), ("is_primitive", _B, True), ("is_static", _B, True),
    ("is_dispatch", _B, True), ("is_special", _B, True), ("signature", _S, True), ("selector", _S, True), ("field", _S, True), ("type_name", _S, True), ("token", _S, True),
)
