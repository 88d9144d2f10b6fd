"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

A source's target repetition rate is its share of the target weights times the documents asked for, over the documents
it has. Every document is repeated as often as a Poisson variable with that mean says: the distribution is inverted at a
uniform number hashed from (seed, doc_id), so runs and retries agree and no state is shared between rows. The copies are
then shuffled globally: a hash of (seed, doc_id, copy) picks the partition and orders the rows in it.

A rate above PIECE is drawn as a sum of independent Poisson variables of equal mean, each inverted at its own hash, which
keeps the terms of the distribution few and far from underflow. Null source is a source of its own; sources that have no
weight get none of the copies; null doc_id hashes as the empty text. Equal doc_ids get equal counts. Texts are never
read. Input columns of any name are carried as they are; where one has the name of an added column, the added one gets
underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import fresh, whole_row

#: The largest mean inverted in one step, and how many terms of its distribution are laid out (the rest is below 2^-52).
PIECE, TERMS = 8.0, 48
#: The most sources whose rates are broadcast; beyond it, rates join by a shuffle salted SALTS ways.
MAX_BROADCAST_SOURCES, SALTS = 10_000, 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _rates(docs: DataFrame, weights: DataFrame | None, epochs: float) -> DataFrame:
    """source, pieces, cdf (of one piece) for every source that has documents; weights: (source, weight), equal if None."""
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        w = sizes.select("source", "_n", F.lit(1.0).alias("_w"))
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").cast("double").alias("_w"))
        w = sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "_n", F.greatest(F.coalesce("_w", F.lit(0.0)), F.lit(0.0)).alias("_w"))
    total = w.agg(F.sum("_n").alias("_all"), F.sum("_w").alias("_sum"))
    rate = w.crossJoin(F.broadcast(total)).withColumn("rate", F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum") * F.col("_all") * F.lit(float(epochs)) / F.col("_n")).otherwise(F.lit(0.0)))
    rate = rate.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")).withColumn("_m", F.col("rate") / F.col("pieces"))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-F.col("_m")).alias("p"), F.array(F.exp(-F.col("_m"))).alias("cdf")),
        lambda a, k: F.struct(
            (a["p"] * F.col("_m") / k).alias("p"),
            F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col("_m") / k)).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )
    return rate.select("source", "rate", "pieces", terms.alias("cdf"))


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, seed: str = "mix", names: tuple[str, str] = ("_copy", "_shuffle_key")) -> DataFrame:
    """Copies of the rows of docs in a global random order, with the number of the copy (from 1) and the key of the order
    after its own columns.

    epochs times the number of documents is the expected number of copies."""
    rates = _rates(docs.select("source"), weights, epochs).select(F.col("source").alias("_src"), F.col("pieces").alias("_pieces"), F.col("cdf").alias("_cdf"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(whole_row(docs).alias("row"), F.col("source").alias("from"), key.alias("id"))
    if docs.select("source").distinct().limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        rated = rows.join(F.broadcast(rates), F.col("from").eqNullSafe(F.col("_src")))
    else:
        salted = rates.withColumn("_rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = rows.withColumn("_salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(salted, (F.col("_salt") == F.col("_rate_salt")) & F.col("from").eqNullSafe(F.col("_src")))
    draws = F.transform(F.sequence(F.lit(1), F.col("_pieces")), lambda i: uniform(F.lit(seed), F.col("id"), i.cast("string")))
    rated = rated.withColumn("_draws", draws)
    count = F.aggregate("_draws", F.lit(0), lambda a, u: a + F.size(F.filter("_cdf", lambda c: c <= u)))
    copies = rated.withColumn("_count", count).where("_count > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    copies = copies.withColumn("_shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), "id", F.lit("copy"), F.col("_copy").cast("string")).cast("binary")))
    out = copies.select("row.*", F.col("_copy").alias(fresh(docs, names[0])), F.col("_shuffle_key").alias(order := fresh(docs, names[1])))
    return out.repartition(F.col(order)).sortWithinPartitions(order)
