"""Tables in the folder that the driver and all executors share.

All of an application's lie below one folder, which clear() deletes once no result is read any more; results are lazy, so
nothing can know earlier. The folder that a local master gets for lack of a setting goes when Python ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master without the setting gets one of its own, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pointweave-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/pointweave/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes everything that this application has put in the shared folder; results that read it can't be read again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, path: str) -> int:
    """Writes df as Parquet to path and gives the number of its rows, in one job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get.get("n", 0)


class Growing:
    """A relation that only grows: each addition is a folder of its own, so nothing is written twice. Many small folders
    are merged, MERGE of one size at a time, so that a long loop reads few files."""

    MERGE = 8

    def __init__(self, spark: SparkSession, name: str, schema):
        self.spark, self.name, self.schema, self.parts = spark, name, schema, []

    def read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    @property
    def all(self) -> DataFrame:
        return self.read(*(path for path, _ in self.parts))

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """(the added rows as they lie in the folder, their number)."""
        path = shared_path(self.spark, self.name)
        n = stored(df.select(*self.fields()), path)
        if n:
            self.parts.append((path, 0))
        while len(self.parts) >= self.MERGE and len({rank for _, rank in self.parts[-self.MERGE :]}) == 1:
            small, rank = [p for p, _ in self.parts[-self.MERGE :]], self.parts[-1][1]
            merged = shared_path(self.spark, self.name)
            self.read(*small).write.parquet(merged)
            self.parts[-self.MERGE :] = [(merged, rank + 1)]
        return self.read(path), n

    def fields(self) -> list[str]:
        return self.schema.fieldNames() if hasattr(self.schema, "fieldNames") else [f.split()[0] for f in self.schema.replace("<", " <").split(", ")]


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name: 1, 2, ... in the order of its columns, or as its rows lie if none is given. Ranges are sorted on their
    own and told the sizes of those before."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = written(placed.select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"), "*"), "numbered")
    sizes = sorted((r._p, r.n) for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "_p int, _before bigint")
    local = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_before") + local + 1).drop("_p", "_i", "_before")
