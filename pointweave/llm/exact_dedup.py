"""Exact deduplication of texts by two-pass Bloom filtering.

Pass one sends the 64-bit hash of every text through a filter that keeps the hashes met more than once. Pass two tests
each row against it: a row that the filter lacks is unique for certain and passes straight through. Only the other rows
shuffle, as (doc_id, SHA-256), and are grouped exactly, so false positives of the filter cost time and never change
the result.

Null text counts as empty, so null and empty texts are one group. Among equal texts the row with the largest doc_id
stays; null doc_ids rank below all others. Rows that share both text and doc_id are all marked as kept by annotate() and
are reduced to one by deduplicate(). Columns beyond doc_id and text are carried by deduplicate() whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.bloom import MAX_BITS, maybe_repeated, repeated_filter
from pointweave.llm.common import join_groups, lean, session, ship, whole_row, written


def _digests(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("sha")), "dedup-digests").withColumn("h", F.xxhash64("sha"))


def _marked(digests: DataFrame, bitmap: np.ndarray, bits: int) -> DataFrame:
    spark = session(digests)
    ship(spark)
    held = spark.sparkContext.broadcast(bitmap)

    def test(batches):
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), pa.array(maybe_repeated(h, held.value, bits))], ["doc_id", "sha", "maybe"])

    return digests.mapInArrow(lean(test), f"doc_id {digests.schema['doc_id'].dataType.simpleString()}, sha binary, maybe boolean")


def annotate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = _digests(docs)
    n = digests.count()
    bitmap, bits = repeated_filter(digests, "h", n, max_bits)
    marked = _marked(digests, bitmap, bits)
    single = marked.where(~F.col("maybe")).select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    rows = marked.where("maybe").select("doc_id", "sha")
    groups = rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = join_groups(rows, groups, ["sha"], "group_size", n)
    return single.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay, with all columns. Rows whose text is surely unique never shuffle.

    A repeated text takes three looks: its group's doc_id (as above), the rows that carry it, and one of equal rows."""
    digests = _digests(docs)
    n = digests.count()
    bitmap, bits = repeated_filter(digests, "h", n, max_bits)
    groups = _marked(digests, bitmap, bits).where("maybe").groupBy("sha").agg(F.max("doc_id").alias("_keep"))
    spark = session(docs)
    held = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(maybe_repeated(h.to_numpy(zero_copy_only=False), held.value, bits))

    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    tested = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("own"), sha.alias("_sha")).withColumn("maybe", maybe(F.xxhash64("_sha")))
    straight = tested.where(~F.col("maybe")).select("row")
    keepers = groups.select(F.col("sha").alias("_k_sha"), "_keep")
    # (text, doc_id) spreads the join over the doc_ids of a hot group; only the keeper's rows find a partner
    kept = tested.where("maybe").join(keepers, (F.col("_sha") == F.col("_k_sha")) & F.col("own").eqNullSafe(F.col("_keep")), "left_semi")
    return straight.unionByName(kept.dropDuplicates(["_sha"]).select("row")).select("row.*")
