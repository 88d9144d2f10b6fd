"""Class hierarchy and method resolution. Only the superclass chain is walked, so interface defaults stay unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.fixpoint import ancestors


def methods(functions: DataFrame) -> DataFrame:
    """class_id, selector, fn_id of instance methods; of several for one class and selector the last counts."""
    own = functions.where("not is_static and class_id is not null")
    return own.groupBy("class_id", F.col("name_id").alias("selector")).agg(F.max("fn_id").alias("fn_id"))


def static_functions(functions: DataFrame) -> DataFrame:
    """method, fn_id of static functions by name; of several with one name the last counts."""
    return functions.where("is_static").groupBy(F.col("name_id").alias("method")).agg(F.max("fn_id").alias("fn_id"))


def resolve(classes: DataFrame, method: DataFrame) -> DataFrame:
    """class_id, selector, fn_id: for every class and selector that it or an ancestor defines, the nearest definition."""
    up = ancestors(classes)
    found = up.join(method.withColumnRenamed("class_id", "ancestor"), "ancestor")
    return found.groupBy("class_id", "selector").agg(F.min_by("fn_id", "depth").alias("fn_id"))


def kinds(resolved: DataFrame) -> DataFrame:
    """class_id, kind: the least of the classes whose selectors lead to the same functions, from resolve()."""
    methods = resolved.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("selector", "fn_id"))).alias("methods"))
    return methods.groupBy("methods").agg(F.min("class_id").alias("kind"), F.collect_list("class_id").alias("all")).select(F.explode("all").alias("class_id"), "kind")


def arity_errors(calls: DataFrame, params: DataFrame) -> DataFrame:
    """instr_id, fn_id of virtual calls (instr_id, fn_id, n_args with receiver) that leave out more than a variable-length last parameter."""
    sizes = params.groupBy("fn_id").agg(F.count("pos").alias("n_params"))
    return calls.join(sizes, "fn_id").where("n_args < n_params - 1").select("instr_id", "fn_id")
