"""From lowered instructions, which name things by text, to a program, which numbers them.

Each space of names (variables, fields, classes, methods) is numbered on its own, in the order of the names, by sorting
ranges; the numbers replace the names by joins, so no table of names is held in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.lowering import COLUMNS
from pointweave.program import Program
from pointweave.storage import numbered, written

VARIABLE, FIELD, CLASS, METHOD = "variable", "field", "class", "method"


def names(lowered: DataFrame, functions: DataFrame, params: DataFrame, classes: DataFrame) -> DataFrame:
    """space, name, id of everything that is named. functions: fn_id, name, is_static, class_name; params: fn_id, pos, ssa;
    classes: name, super_name."""
    said = lambda df, space, column: df.select(F.lit(space).alias("space"), F.col(column).alias("name"))
    out = said(lowered, VARIABLE, "target").unionByName(said(lowered, VARIABLE, "source")).unionByName(said(lowered.select(F.explode("args").alias("arg")), VARIABLE, "arg"))
    out = out.unionByName(said(params.select(_parameter()), VARIABLE, "name")).unionByName(said(lowered, FIELD, "field")).unionByName(said(lowered, METHOD, "method")).unionByName(said(functions, METHOD, "name"))
    out = out.unionByName(said(lowered, CLASS, "type_name")).unionByName(said(functions, CLASS, "class_name")).unionByName(said(classes, CLASS, "name")).unionByName(said(classes, CLASS, "super_name"))
    return written(numbered(out.where("name is not null").distinct(), ["space", "name"], "id"), "names")


def _parameter():
    return F.concat(F.col("fn_id").cast("string"), F.lit("#"), F.col("ssa").cast("string")).alias("name")


def assemble(lowered: DataFrame, functions: DataFrame, params: DataFrame, classes: DataFrame, entries: DataFrame) -> tuple[Program, DataFrame, DataFrame]:
    """(the program, names as above, lowered instructions with their instr_id). Equal instructions count once."""
    known = names(lowered, functions, params, classes)
    instr = written(numbered(lowered.distinct(), list(COLUMNS), "instr_id"), "lowered")

    def number(df: DataFrame, space: str, column: str, to: str) -> DataFrame:
        return df.join(known.where(F.col("space") == space).select(F.col("name").alias(column), F.col("id").alias(to)), column, "left")

    args = number(instr.select("instr_id", F.posexplode("args").alias("at", "arg")), VARIABLE, "arg", "_arg")
    args = args.groupBy("instr_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "_arg"))), lambda x: x["_arg"]).alias("_args"))
    made = instr.join(args, "instr_id", "left")
    for space, column in ((VARIABLE, "target"), (VARIABLE, "source"), (FIELD, "field"), (CLASS, "type_name"), (METHOD, "method")):
        made = number(made, space, column, f"_{column}")
    empty = F.when(F.col("kind").isin("scall", "vcall"), F.coalesce("_args", F.array().cast("array<bigint>")))
    made = made.select("instr_id", "fn_id", "kind", F.col("_target").alias("target"), F.col("_source").alias("source"), F.col("_field").alias("field"), F.col("_type_name").alias("class_id"), F.col("_method").alias("method"), empty.alias("args"))
    held = number(number(functions, METHOD, "name", "name_id"), CLASS, "class_name", "class_id").select("fn_id", "class_id", "is_static", "name_id")
    bound = number(params.select("fn_id", "pos", _parameter()), VARIABLE, "name", "var_id").select("fn_id", "pos", "var_id")
    tree = number(number(classes, CLASS, "name", "class_id"), CLASS, "super_name", "super_id").select("class_id", "super_id")
    program = Program(*(written(df, name) for name, df in (("classes", tree), ("functions", held), ("params", bound), ("instr", made))), entries)
    return program, known, instr


def named(pts: DataFrame, known: DataFrame, instr: DataFrame) -> DataFrame:
    """pts with the names of variables and fields, and function@position:variable for heap items; for no contexts."""
    variables = known.where(F.col("space") == VARIABLE).select(F.concat(F.lit("V"), F.col("id").cast("string")).alias("label"), F.col("name").alias("said"))
    heaps = instr.where("kind = 'alloc'").select(F.concat(F.lit("H"), F.col("instr_id").cast("string")).alias("label"), F.concat(F.col("fn_id").cast("string"), F.lit("@"), F.col("pos").cast("string"), F.lit(":"), "target", F.lit(":"), "type_name").alias("said"))
    fields = known.where(F.col("space") == FIELD).select(F.col("id").cast("string").alias("_f"), F.col("name").alias("_field"))
    nodes = pts.select("node").distinct().where("startswith(node, 'F')").select("node", F.regexp_replace("node", r"^F(\d+)\..*$", "V$1").alias("label"), F.substring_index("node", ".", -1).alias("_f"))
    parts = nodes.join(variables, "label").join(fields, "_f").select(F.col("node").alias("label"), F.concat("said", F.lit("."), "_field").alias("said"))
    every = variables.unionByName(heaps).unionByName(parts)
    return pts.join(every.select(F.col("label").alias("node"), F.col("said").alias("_node")), "node").join(heaps.select(F.col("label").alias("heap"), F.col("said").alias("_heap")), "heap").select(F.col("_node").alias("node"), F.col("_heap").alias("heap"))
