"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are n-grams of the whole text, hashed into buckets: words, pairs of neighbouring words, the words' shapes (case,
digits, final punctuation) singly and in pairs, and for every word whether it stands again one, two or three words later.
A feature's value is its count over the square root of the text's feature count. Executors turn the labelled sample into sparse rows; the driver
runs the per-coordinate FTRL-proximal updates over them in hash order; the weights are broadcast and every text is
scored as a sparse dot product on Arrow batches.

Null and empty texts have no feature and get the score of the bias alone. Labels that are null are left out; of several
labels for one doc_id the largest counts. With no label at all every score is 0.5, predicted 1. Equal texts get equal
scores; doc_ids may be numbers or texts, null or repeated. Columns other than those named are never read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.bloom import mix
from pointweave.llm.common import crc_mod, sampled, session, ship
from pointweave.llm.wordhash import word_hashes

BUCKETS = 1 << 18
REPEATS = (1, 2, 3)
#: About so many labelled rows, picked by a hash of doc_id, are learnt from; all when there are fewer.
TRAIN_ROWS = 8_000
EPOCHS, FTRL_ALPHA, FTRL_BETA, L1, L2 = 4, 0.3, 1.0, 0.02, 0.02


def features(words: np.ndarray, shapes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text) of every word, pair of neighbouring words, shape, pair of shapes, and repetition."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    shape = mix(shapes + np.uint64(0x5851F42D4C957F2D))
    found, of = [words, shape], [owner, owner]
    for gap in REPEATS:
        same = owner[:-gap] == owner[gap:]
        if gap == 1:
            found += [mix(words[:-1] * np.uint64(3) + words[1:])[same], mix(shape[:-1] * np.uint64(5) + shape[1:])[same]]
            of += [owner[:-1][same]] * 2
        again = (same & (words[:-gap] == words[gap:])).nonzero()[0]
        found.append(mix(np.full(len(again), 7919 * gap, np.uint64)))
        of.append(owner[again])
    bucket = np.concatenate(found) & np.uint64(BUCKETS - 1)
    return bucket.astype(np.int64), np.concatenate(of)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for first, words, shapes, offsets in word_hashes(texts, True):
            bucket, owner = features(words, shapes, offsets)
            n = np.bincount(owner, minlength=len(offsets) - 1)
            dot = np.bincount(owner, self.weights[bucket], minlength=len(offsets) - 1)
            z[first : first + len(n)] += dot / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """FTRL-proximal for logistic loss: z and n per coordinate, weights follow in closed form."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((FTRL_BETA + np.sqrt(self.n[at])) / FTRL_ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / FTRL_ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. Learns from a sample of about `rows` labels."""
    ship(session(docs))
    known = sampled(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", rows, 12)
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def sparse(batches):
        from pointweave.llm import quality

        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            at, val = [b""] * len(texts), [b""] * len(texts)
            for first, words, shapes, offsets in word_hashes(texts, True):
                bucket, owner = quality.features(words, shapes, offsets)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    u, n = np.unique(bucket[order[cuts[i] : cuts[i + 1]]], return_counts=True)
                    at[first + i] = u.astype(np.uint32).tobytes()
                    val[first + i] = (n / np.sqrt(max(n.sum(), 1))).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(at, pa.binary()), pa.array(val, pa.binary())], ["doc_id", "quality", "at", "val"])

    kinds = {c: joined.schema[c].dataType.simpleString() for c in ("doc_id", "quality")}
    got = joined.select("doc_id", "quality", "text").mapInArrow(sparse, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, at binary, val binary").collect()
    got.sort(key=lambda r: _order(r.doc_id))
    ftrl = Ftrl(BUCKETS)
    ready = [(np.r_[np.frombuffer(r.at, np.uint32).astype(np.int64), BUCKETS], np.r_[np.frombuffer(r.val, np.float32).astype(float), 1.0], int(r.quality >= 1)) for r in got]
    for _ in range(EPOCHS):
        for at, x, y in ready:
            ftrl.learn(at, x, y)
    w = ftrl.weights(np.arange(BUCKETS + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def _order(doc_id) -> int:
    """A number by which the rows are learnt in a mixed order; ids may be numbers or texts."""
    if isinstance(doc_id, int):
        return int(mix(np.array([doc_id], np.int64).view(np.uint64))[0])
    return int.from_bytes(hashlib.blake2b(str(doc_id).encode(), digest_size=8).digest(), "little")


def classify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep and the score of every row of docs."""
    spark = session(docs)
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            s = held.value.score(b.column("_text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], [*keep, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(score, f"{schema}, score double")


def held_out(df: DataFrame):
    """The folds of the contract: rows whose crc32 of doc_id, modulo 3, is 1 are never learnt from."""
    return F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = train(docs, labels.where(~held_out(labels)))
    out = classify(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(docs).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
