"""Shared storage, code shipping and skew-safe joins for the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.storage import shared_path, written

__all__ = ["ARROW_BATCH", "HOT_GROUPS", "crc_mod", "filesystem", "fresh", "join_groups", "lean", "sampled", "session", "shared_path", "shared_uri", "ship", "table", "whole_row", "written"]

#: The most rows and bytes of an Arrow batch.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: At most this many groups can each hold more than one part in HOT_GROUPS of all rows.
HOT_GROUPS = 1000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, with its scheme, for pyarrow.fs."""
    path = shared_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI in the shared folder; works on the driver and on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, and bounds the session's Arrow batches: rows
    here can be long texts, and a Python worker holds a batch several times over."""
    for key, most in ARROW_BATCH.items():
        if int(re.match(r"-?\d+", spark.conf.get(key))[0]) not in range(1, most + 1):
            spark.conf.set(key, str(most))
    sc = spark.sparkContext
    if getattr(sc, "_pointweave_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    if not top.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="pointweave-code-")) / "pointweave_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(str(target))
    sc._pointweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy() -> None:
    """Gives memory that is free back to the system; allocators keep it otherwise, and workers outlive their tasks."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def lean(run):
    """A function of Arrow batches that leaves its worker without the memory it no longer needs."""

    def whole(batches):
        from pointweave.llm.common import tidy

        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that whatever they are called they meet no column of an operator's own."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def fresh(df: DataFrame, name: str) -> str:
    """The name, after as many underscores as make it differ from all columns of df (upper and lower case are alike)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def sampled(df: DataFrame, key: str, rows: int, salt: int) -> DataFrame:
    """The rows of df whose hashed key falls below a threshold set so that about `rows` remain, or all when there are fewer."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) < F.lit(int(rows / n * (1 << 30))))


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows with groups, which has one row for each key and the group's size, without a skewed task.

    Groups of more than total / HOT_GROUPS rows are fewer than HOT_GROUPS by counting, so they are broadcast; all
    smaller groups join by a shuffle on the key, where none can outweigh a partition. Keys must not be null."""
    limit = total // HOT_GROUPS
    named = [c for c in groups.columns if c not in key]
    hot = F.broadcast(groups.where(F.col(size) > limit).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, key, "left")
    done = marked.where(F.col("_hot")).select(*rows.columns, *named)
    rest = marked.where(F.col("_hot").isNull()).select(*rows.columns)
    return done.unionByName(rest.join(groups.where(F.col(size) <= limit), key, "left").select(*rows.columns, *named))
