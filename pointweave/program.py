"""A program as a set of relations (see schema)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave import schema
from pointweave.operators import hierarchy
from pointweave.storage import written


@dataclass
class Program:
    classes: DataFrame  # class_id, super_id
    functions: DataFrame  # fn_id, class_id, is_static, name_id
    params: DataFrame  # fn_id, pos, var_id
    instr: DataFrame  # instr_id, fn_id, kind, target, source, field, class_id, method, args
    entries: DataFrame  # fn_id

    @classmethod
    def read_parquet(cls, spark: SparkSession, folder: str) -> Program:
        tables = {"classes": schema.CLASS, "functions": schema.FUNCTION, "params": schema.PARAM, "instr": schema.INSTR, "entries": schema.ENTRY}
        return cls(**{name: spark.read.schema(kind).parquet(f"{folder}/{name}") for name, kind in tables.items()})

    def write_parquet(self, folder: str) -> None:
        for name in ("classes", "functions", "params", "instr", "entries"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    def static_functions(self) -> DataFrame:
        return hierarchy.static_functions(self.functions)

    def methods(self) -> DataFrame:
        return hierarchy.methods(self.functions)

    @cached_property
    def _resolved(self) -> DataFrame:
        return written(hierarchy.resolve(self.classes, self.methods()), "resolved")

    def resolved(self) -> DataFrame:
        return self._resolved

    @cached_property
    def static_sites(self) -> tuple[DataFrame, int]:
        """(fn_id, method, callee of static calls whose callee is known, their number)."""
        called = self.instr.where("kind = 'scall'").select("fn_id", "method").distinct()
        sites = written(called.join(self.static_functions().withColumnRenamed("fn_id", "callee"), "method").select("fn_id", "method", "callee"), "static-sites")
        return sites, sites.count()

    def returns(self) -> DataFrame:
        return self.instr.where("kind = 'return'").select("fn_id", F.col("source").alias("var_id"))
