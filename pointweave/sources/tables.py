"""Graphs and programs derived from the TPC-H-like tables, as SQL that Spark and DuckDB read alike.

Each text is a query over the tables' names (and over texts named before it); SQL[name] has it, frame() runs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.program import Program
from pointweave.storage import numbered, written

SQL: dict[str, str] = {
    # a supplier's nation is what flows along; every line is an edge
    "supply_seed": "select concat('S', s_suppkey) node, cast(s_nationkey as bigint) heap from supplier",
    "supply_edge": """
        select distinct concat('S', l_suppkey) src, concat('P', l_partkey) dst from lineitem
        union select concat('P', l_partkey), concat('O', l_orderkey) from lineitem
        union select concat('O', o_orderkey), concat('C', o_custkey) from orders
        union select concat('C', c_custkey), concat('N', c_nationkey) from customer
        union select concat('N', n_nationkey), concat('R', n_regionkey) from nation""",
    # transitions between a user's tokens (in 40 groups) within a day
    "token_edge": """
        select distinct src, dst from (
          select node src, lead(node) over (partition by user_id, day order by ts, event_id) dst
          from (select user_id, ts, event_id, cast(ts as date) as day, cast(user_id * 100 + cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 40 as bigint) node from events) a) b
        where dst is not null and src <> dst""",
    # every event adds or deletes an edge between two of a user's 16 nodes, each of which has two possible successors
    "change": """
        select seq, op, u * 100 + k src, u * 100 + (k * 7 + 3 + v) % 16 dst from (
          select cast(event_id as bigint) seq, case when event_type in ('signup', 'view', 'click') then 'add' else 'del' end op, cast(user_id as bigint) u,
            cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 16 k, cast(floor(value) as bigint) % 2 v from events) a""",
    "class": """
        select cast(0 as bigint) class_id, cast(null as bigint) super_id
        union all select cast(1 + r_regionkey as bigint), cast(0 as bigint) from region
        union all select cast(100 + n_nationkey as bigint), cast(1 + n_regionkey as bigint) from nation
        union all select cast(1000 + s_suppkey as bigint), cast(100 + s_nationkey as bigint) from supplier""",
    "function": """
        select cast(c_custkey as bigint) fn_id, cast(100 + c_nationkey as bigint) class_id, c_custkey % 2 = 0 is_static,
          cast(case when c_custkey % 2 = 0 then c_custkey else c_custkey % 5 end as bigint) name_id from customer""",
    "raw_instr": """
        select f, k, pk, sk, cast(2 * ((pk * 31 + sk) % cast(floor((select count(*) from customer) / 2) as bigint)) as bigint) static_callee
        from (select distinct cast(o_custkey as bigint) f, cast(l_linenumber as bigint) k, cast(l_partkey as bigint) pk, cast(l_suppkey as bigint) sk
              from lineitem join orders on l_orderkey = o_orderkey) t""",
    # the same lines, but calls are as rare as in programs: the others of the call lines are loads and stores
    "raw_program": """
        select f, k, pk, sk, cast(2 * ((pk * 31 + sk) % cast(floor((select count(*) from customer) / 2) as bigint)) as bigint) static_callee
        from (select distinct cast(o_custkey as bigint) f,
                cast(case when l_linenumber = 5 and l_discount < 0.1 then 4 when l_linenumber = 6 and l_discount < 0.1 then 3 else l_linenumber end as bigint) k,
                cast(l_partkey as bigint) pk, cast(l_suppkey as bigint) sk
              from lineitem join orders on l_orderkey = o_orderkey) t""",
    "ssa": """
        select f fn_id, cast(pk % 1000 as int) pos,
          case cast(pk % 13 as int) when 0 then 'array_load' when 1 then 'array_store' when 2 then 'return' when 3 then 'invoke' when 4 then 'get_field' when 5 then 'put_field'
            when 6 then 'check_cast' when 7 then 'pi' when 8 then 'phi' when 9 then 'new' when 10 then 'metadata' when 11 then 'throw' else 'invoke' end op,
          case when sk % 4 = 0 and pk % 13 in (3, 12) then null else pk % 50 end def_id, sk % 50 use0, (pk + sk) % 50 use1, sk % 3 = 0 is_primitive, sk % 2 = 0 is_static,
          pk % 13 = 3 is_dispatch, sk % 5 < 3 is_special, concat('sig', sk % 20, case when sk % 7 = 0 then '.<init>' else '' end) signature, concat('sel', sk % 5) selector,
          concat('f', sk % 4) field, concat('T', sk % 30) type_name, concat('k', sk % 9) token
        from raw_instr""",
    # functions of the program in SSA form, methods of a binary tree of classes
    "ssa_function": """
        select cast(c_custkey as bigint) fn_id, concat('sig', c_custkey % 20, case when c_custkey % 7 = 0 then '.<init>' else '' end) signature, concat('sel', c_custkey % 5) selector,
          c_custkey % 2 = 0 static_flag, concat('T', c_custkey % 30) class_name from customer""",
    "ssa_class": "select distinct concat('T', s_suppkey % 30) name, case when s_suppkey % 30 > 0 then concat('T', cast(floor(s_suppkey % 30 / 2) as int)) end super_name from supplier",
}


def frame(spark: SparkSession, sf_dir: str, name: str, **more: DataFrame) -> DataFrame:
    """The query of that name over the tables in sf_dir."""
    text = SQL[name]
    for table in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "raw_instr"):
        if f" {table}" in text and table != name:
            more.setdefault(table, frame(spark, sf_dir, table) if table in SQL else spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    import re

    text = re.sub(r"\b(from|join) (region|nation|customer|supplier|orders|lineitem|events|raw_instr)\b", r"\1 {\2}", text)
    return spark.sql(text, **{k: v for k, v in more.items() if "{" + k + "}" in text})


def instructions(spark: SparkSession, sf_dir: str, raw: str = "raw_instr") -> DataFrame:
    """The instructions of the derived program (schema.INSTR), one of seven kinds by line number."""
    raw = numbered(written(frame(spark, sf_dir, raw), "raw"), ["f", "k", "pk", "sk"], "instr_id")
    kinds = F.array(*map(F.lit, ("alloc", "assign", "store", "load", "scall", "vcall", "return")))
    target, source = F.col("f") * 100 + F.col("pk") % 20, F.col("f") * 100 + (F.col("pk") * 7 + F.col("sk")) % 20
    args = F.when(F.col("k") == 5, F.array(source, target)).when(F.col("k") == 6, F.array(source))
    return raw.select(
        "instr_id", F.col("f").alias("fn_id"), F.get(kinds, (F.col("k") - 1).cast("int")).alias("kind"), target.alias("target"), source.alias("source"), (F.col("sk") % 4).alias("field"),
        (F.col("sk") + 1000).alias("class_id"), F.when(F.col("k") == 5, F.col("static_callee")).when(F.col("k") == 6, F.col("pk") % 5).alias("method"), args.alias("args"),
    )


def program(spark: SparkSession, sf_dir: str, entries: int | None = None, raw: str = "raw_program") -> Program:
    """The derived program: parameters are a function's variables 0 and 1, entries all functions, or those below a number.

    Every line is an instruction. raw_instr calls in two of seven; raw_program calls less, as programs do, or all sets
    become alike."""
    functions = frame(spark, sf_dir, "function")
    params = functions.select("fn_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).withColumn("var_id", F.col("fn_id") * 100 + F.col("pos"))
    instr = written(instructions(spark, sf_dir, raw), "instr")
    chosen = functions if entries is None else functions.where(F.col("fn_id") < entries)
    return Program(frame(spark, sf_dir, "class"), functions, params, instr, chosen.select("fn_id"))


def ssa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions in SSA form (schema.SSA), with operations by part number."""
    raw = frame(spark, sf_dir, "ssa")
    uses = F.when(F.col("op") == "return", F.when(F.col("use1") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array("use0"))).otherwise(F.array("use0", "use1"))
    return raw.withColumn("uses", uses).drop("use0", "use1")


def fingerprint(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """What tells the tables' present files from earlier ones: path, length and time of change of each."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in names:
        for file in sorted(spark.read.parquet(f"{sf_dir}/{name}.parquet").inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
            status = path.getFileSystem(hadoop).getFileStatus(path)
            found.append((file, status.getLen(), status.getModificationTime()))
    return tuple(found)
