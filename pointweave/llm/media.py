"""Media columns: content-defined chunks of payloads, stored once each, and media put together again and verified.

A text's payload is its UTF-8 bytes, zero bytes appended up to a positive multiple of 64. Its medium is a WAV file of
8-bit mono samples, the payload being the samples. A rolling gear hash cuts the payload where its leading bits are zero,
so equal passages give equal chunks wherever they stand. The manifest lists each document's chunk digests in order.

Digests, not payloads, are compared across documents: a Bloom filter finds those that may occur more than once. Chunks
surely unique are stored with their document, without a shuffle. Of the others, a Spark aggregation elects one owner for
each digest, and a join tells the documents concerned which of their chunks to store. Reading back, a document with only unique chunks is
put together from its own row; the other media, once for each distinct medium, join their chunk lists with the chunks by
digest. Every medium is checked against its SHA-256, and features come from the payload read back. Joins that carry
payloads are merge joins at every size, so that their cost grows with the input and not in steps.

Null text counts as empty. Rows with equal texts have equal values. Null and repeated doc_ids are kept as they are.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.bloom import maybe_repeated, mix, repeated_filter
from pointweave.llm.common import join_groups, session, ship, written

UNIT, RATE = 64, 8000
#: A cut needs so many leading zero bits (a chunk of 4096 bytes on average); the least and largest chunk; bytes hashed at once.
CUT_BITS, LEAST, MOST, WINDOW = 12, 1 << 10, 1 << 14, 1 << 20
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def header(payload_bytes: int) -> bytes:
    """The header of a WAV file with so many 8-bit mono samples."""
    size = payload_bytes & 0xFFFFFFFF
    return b"RIFF" + struct.pack("<I", (size + 36) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", size)


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks. The gear hash at a byte covers the 32 bytes up to it."""
    buf, found = np.frombuffer(data, np.uint8), []
    for at in range(0, len(buf), WINDOW):
        low = max(0, at - 31)
        h = _GEAR[buf[low : at + WINDOW]]
        for k in (1, 2, 4, 8, 16):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        hit = np.flatnonzero(h[at - low :] >> np.uint32(32 - CUT_BITS) == 0)
        found.append(hit + at + 1)
    found = np.concatenate(found).tolist() if found else []
    out, start, i, n = [], 0, 0, len(data)
    while n - start > LEAST:
        while i < len(found) and found[i] < start + LEAST:
            i += 1
        end = min(found[i] if i < len(found) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n or not out:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(payload: bytes) -> str:
    """Mean and root mean square of the samples and how often they cross the middle."""
    buf, total, squares, crossings, last = np.frombuffer(payload, np.uint8), 0, 0, 0, None
    for i in range(0, len(buf), WINDOW):
        part = buf[i : i + WINDOW].astype(np.int64)
        total += int(part.sum())
        squares += int(((part - 128) ** 2).sum())
        up = part >= 128
        crossings += int((up[1:] != up[:-1]).sum()) + int(last is not None and last != bool(up[0]))
        last = bool(up[-1])
    n = len(buf)
    return f"mean={total / n:.4f};rms={(squares / n) ** 0.5:.4f};crossings={crossings}"


_RESULT = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def checked(media: bytes, sha: bytes) -> tuple:
    """The result columns of a medium read back."""
    if hashlib.sha256(media).digest() != sha:
        raise ValueError("a medium read back differs from the one stored")
    payload = media[44:]
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha.hex(), features(payload)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)] if rows else [pa.array([], k) for k in _KINDS]


def _manifest(docs: DataFrame) -> DataFrame:
    def run(batches):
        from pointweave.llm import media

        for b in batches:
            n, size, sha, lists, lengths = [], [], [], [], []
            for t in b.column("text"):
                bytes_, data = media.payload_of(t.as_py())
                parts = media.chunks(data)
                n.append(bytes_)
                size.append(len(data))
                sha.append(hashlib.sha256(media.header(len(data)) + data).digest())
                lists.append([media.digest(p) for p in parts])
                lengths.append(len(parts))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.binary()), pa.array(lists, pa.list_(pa.binary()))],
                ["doc_id", "n_bytes", "payload_bytes", "sha", "chunks"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, sha binary, chunks array<binary>")


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes the media of docs (doc_id, text) to the shared folder. Returns the tables

    manifest  doc_id, n_bytes, payload_bytes, sha, chunks (digests in order), shared (some chunk is stored by digest)
    own       doc_id, n_bytes, sha, count, parts (idx, data): a document's chunks that are its own alone
    pool      digest, data: chunks that several places may hold, each once"""
    spark = session(docs)
    ship(spark)
    manifest = written(_manifest(docs), "media-manifest")
    each = manifest.select("doc_id", F.explode("chunks").alias("digest"))
    hashed = each.select(F.xxhash64("digest").alias("h"))
    bitmap, bits = repeated_filter(hashed, "h", hashed.count())
    held = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(h):
        import pandas as pd

        return pd.Series(maybe_repeated(h.to_numpy(), held.value, bits))

    listed = each.where(maybe(F.xxhash64("digest")))
    owned = listed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("digest").alias("owned")).withColumnRenamed("doc_id", "_o")
    repeats = listed.select("doc_id", "digest").groupBy("doc_id").agg(F.collect_set("digest").alias("repeated"))
    repeats = written(repeats.join(owned, F.col("doc_id").eqNullSafe(F.col("_o")), "left").select("doc_id", "repeated", "owned"), "media-repeats")
    mixed, mixed_bits = repeated_filter(repeats.select(F.xxhash64("doc_id").alias("h")), "h", repeats.count(), least=1)
    tested = spark.sparkContext.broadcast(mixed)

    @F.pandas_udf("boolean")
    def may_share(h):
        import pandas as pd

        return pd.Series(maybe_repeated(h.to_numpy(), tested.value, mixed_bits))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def split(batches):
        from pointweave.llm import media

        for b in batches:
            if "h" in b.schema.names:  # documents that may share a chunk come by the join
                b = b.filter(pa.array(~maybe_repeated(b.column("h").to_numpy(zero_copy_only=False), tested.value, mixed_bits)))
            repeated, owned = (b.column(c) if c in b.schema.names else None for c in ("repeated", "owned"))
            rows, size = [], 0
            for i, (d, t) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text"))):
                n, data = media.payload_of(t.as_py())
                parts = media.chunks(data)
                again = set(repeated[i].as_py() or ()) if repeated is not None else set()
                mine = set(owned[i].as_py() or ()) if owned is not None else set()
                known = [media.digest(p) for p in parts] if again else [b""] * len(parts)
                alone = [{"idx": k, "data": p} for k, p in enumerate(parts) if known[k] not in again]
                pool = [{"digest": h, "data": p} for h, p in {h: p for h, p in zip(known, parts) if h in mine}.items()]
                rows.append((d, n, hashlib.sha256(media.header(len(data)) + data).digest(), len(parts), alone, pool))
                size += len(data)
                if size > WINDOW:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    part, pooled = pa.list_(pa.struct([("idx", pa.int32()), ("data", pa.binary())])), pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))

    def out(rows):
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), part, pooled]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "sha", "count", "parts", "pool"])

    schema = "doc_id long, n_bytes long, sha binary, count int, parts array<struct<idx: int, data: binary>>, pool array<struct<digest: binary, data: binary>>"
    alone = slim.withColumn("h", F.xxhash64("doc_id")).mapInArrow(split, schema)
    some = slim.where(may_share(F.xxhash64("doc_id"))).join(repeats.withColumnRenamed("doc_id", "_d").hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    both = alone.unionByName(some.select("doc_id", "text", "repeated", "owned").mapInArrow(split, schema))
    stored = written(both.where("size(parts) > 0 or size(pool) > 0"), "media-store", compression="zstd")
    own = stored.where("size(parts) > 0").drop("pool")
    pool = stored.select(F.explode("pool").alias("p")).select("p.digest", "p.data")
    # only documents that may share a chunk are joined, once: of a repeated doc_id some rows may share one, others not
    may = may_share(F.xxhash64("doc_id"))
    joined = manifest.where(may).join(repeats.select(F.col("doc_id").alias("_d"), "repeated").hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    marked = joined.withColumn("shared", F.coalesce(F.arrays_overlap("chunks", "repeated"), F.lit(False))).drop("_d", "repeated")
    manifest = written(marked.unionByName(manifest.where(~may).withColumn("shared", F.lit(False))), "media-marked")
    return manifest, own, pool


def read(manifest: DataFrame, own: DataFrame, pool: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the result columns of every document, from the stored chunks."""
    ship(session(manifest))
    results = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def whole(batches):
        from pointweave.llm import media

        for b in batches:
            rows = []
            for sha, parts in zip(b.column("sha"), b.column("parts")):
                data = b"".join(p["data"] for p in sorted(parts.as_py(), key=lambda p: p["idx"]))
                rows.append(media.checked(media.header(len(data)) + data, sha.as_py()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *_columns(rows)], ["doc_id", "n_bytes", *_RESULT])

    complete = own.where("size(parts) = count").select("doc_id", "n_bytes", "sha", "parts").mapInArrow(whole, f"doc_id long, n_bytes long, {results}")

    # the other media, each once: their chunk lists by digest, and the chunks that only they have
    rest = manifest.where("shared")
    distinct = rest.groupBy("sha").agg(F.first("chunks").alias("chunks"), F.count(F.lit(1)).alias("_n"))
    listed = distinct.select("sha", F.posexplode("chunks").alias("idx", "digest"))
    known = own.where("size(parts) < count").select("sha", F.explode("parts").alias("p")).select("sha", "p.idx", "p.data")
    pooled = listed.join(pool.dropDuplicates(["digest"]).hint("merge"), "digest").select("sha", "idx", "data")

    def assemble(batches):
        from pointweave.llm import media

        now, parts = None, {}

        def done():
            data = b"".join(parts[i] for i in sorted(parts))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), *_columns([media.checked(media.header(len(data)) + data, now)])], ["sha", *_RESULT])

        for b in batches:
            for sha, idx, data in zip(b.column("sha").to_pylist(), b.column("idx").to_pylist(), b.column("data").to_pylist()):
                if sha != now and parts:
                    yield done()
                    parts = {}
                now = sha
                parts[idx] = data
        if parts:
            yield done()

    ordered = pooled.unionByName(known).repartition("sha").sortWithinPartitions("sha")
    built = ordered.mapInArrow(assemble, f"sha binary, {results}")
    groups = built.join(distinct.select("sha", "_n"), "sha")
    total = manifest.count()
    joined = join_groups(rest.select("doc_id", "n_bytes", "sha"), written(groups, "media-built"), ["sha"], "_n", total)
    return complete.unionByName(joined.select("doc_id", "n_bytes", *_RESULT))


def round_trip(docs: DataFrame) -> DataFrame:
    return read(*store(docs))
