"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams are taken on the executors from a bounded sample of labelled rows and added up by Spark; the log
probabilities, one dense row for each language, are broadcast. Scoring works on Arrow batches in numpy: the n-grams of
a block of texts become indices, each language's row is gathered at them and summed by document.

A text that is null or has no letter is `und` with score 0. Otherwise the score is the posterior probability of the
language predicted; ties go to the language that sorts first. With no labelled row to learn from, every text is `und`.
Long texts are scored in windows, so memory does not grow with the length of a text. Other columns are never read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pointweave.llm.common import crc_mod, lean, sampled, session, ship, whole_row

#: Buckets of the hashed n-grams, their lengths, and the additive smoothing.
BUCKETS, ORDERS, ALPHA = 1 << 15, (1, 2, 3), 0.1
#: About so many labelled rows, picked by a hash of doc_id, train the model. All are used when there are fewer.
TRAIN_ROWS = 20_000
#: Code points handled at once.
WINDOW = 1 << 18
#: Below this posterior probability the pipeline rejects a document.
MIN_SCORE = 0.5

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def windows(texts: list[str | None]):
    """Yields (code points, index of the text that each window belongs to, start of each window) for blocks of texts.

    Two line ends go before each text, so that no n-gram of up to three code points holds parts of two texts; a window
    of a long text starts with the last two code points of the one before, whose own n-grams end there."""
    codes: list[np.ndarray] = []
    owner: list[int] = []
    starts: list[int] = []
    held = 0
    gap = np.array([10, 10], np.uint32)
    for i, t in enumerate(texts):
        if not t:
            continue
        c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(c), WINDOW):
            part = np.concatenate([gap if at == 0 else c[at - 2 : at], c[at : at + WINDOW]])
            starts.append(held)
            owner.append(i)
            codes.append(part)
            held += len(part)
            if held >= WINDOW:
                yield np.concatenate(codes), np.array(owner), np.array(starts)
                codes, owner, starts, held = [], [], [], 0
    if held:
        yield np.concatenate(codes), np.array(owner), np.array(starts)


def grams(codes: np.ndarray, starts: np.ndarray):
    """Yields for each order the bucket at every position where an n-gram ends, 0 to the end; invalid ends come as -1."""
    first = np.zeros(len(codes), np.int8)
    first[starts] = 1
    first[starts[starts + 1 < len(codes)] + 1] = 1
    base = codes * np.uint32(0x9E3779B1)
    for n in ORDERS:
        h = base.copy()
        for k in range(1, n):
            h[k:] = (h[k:] ^ (h[k:] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + base[:-k] * np.uint32(2 * k + 1)
        h ^= h >> np.uint32(16)
        h = h * np.uint32(0xC2B2AE35) + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
        at = (h >> np.uint32(32 - 15)).astype(np.int32)
        at[first == 1] = -1
        yield at


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # languages x (buckets + 1), the last column 0
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        total = np.zeros((len(self.langs), len(texts)))
        has = np.zeros(len(texts), bool)
        is_letter = letters()
        if self.langs:
            for codes, owner, starts in windows(texts):
                np.logical_or.at(has, owner, np.logical_or.reduceat(is_letter[codes], starts))
                for at in grams(codes, starts):
                    for k in range(len(self.langs)):
                        np.add.at(total[k], owner, np.add.reduceat(self.logp[k][at], starts, dtype=np.float64))
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        total += self.prior[:, None]
        best = total.argmax(0)
        top = total.max(0)
        score = 1 / np.exp(total - top).sum(0)
        return [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())], np.where(has, score, 0.0).tolist()


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of the rows of docs (doc_id, text, lang) whose lang is not null, from a sample of about `rows`."""
    ship(session(docs))
    labelled = sampled(docs.select("doc_id", "text", "lang").where("lang is not null"), "doc_id", rows, 11).select("text", "lang")

    def count(batches):
        from pointweave.llm import langid

        counts: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                held = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                docs_of[lang] = docs_of.get(lang, 0) + len(own)
                for codes, _, starts in langid.windows(own):
                    for at in langid.grams(codes, starts):
                        held += np.bincount(at + 1, minlength=BUCKETS + 1)[1:]
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            names = [lang] * (len(at) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.r_[at, -1]), pa.array(np.r_[held[at], docs_of[lang]])], ["lang", "bucket", "n"])

    found = labelled.mapInArrow(lean(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    logp = np.zeros((len(langs), BUCKETS + 1), np.float32)
    prior = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        held = np.zeros(BUCKETS)
        grams_ = own[own["bucket"] >= 0]
        held[grams_["bucket"].to_numpy()] = grams_["n"].to_numpy()
        logp[k, :BUCKETS] = np.log((held + ALPHA) / (held.sum() + ALPHA * BUCKETS))
        prior[k] = float(own[own["bucket"] == -1]["n"].sum())
    prior = np.log(prior / prior.sum()) if len(langs) else prior
    return Model(langs, logp, prior)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs with the columns lang_pred and score after those in keep (all of docs, if None; text is always read)."""
    spark = session(docs)
    ship(spark)
    keep = docs.columns if keep is None else keep
    held = spark.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            text = b.column("_text")
            pred, p = held.value.score(text.to_pylist())
            kept = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(p, pa.float64())], [*keep, "lang_pred", "score"])

    slim = docs.select(*keep, F.col("text").alias("_text"))
    kinds = StructType([slim.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    return slim.mapInArrow(lean(score), kinds)


def held_out(docs: DataFrame):
    """The folds of the contract: rows whose crc32 of doc_id, modulo 4, is 2 are never learnt from."""
    return F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learnt from the rows that are not held out."""
    model = train(docs.where(~held_out(docs)))
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out(docs).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, least: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is known with at least that probability, with their own columns."""
    row = docs.select(whole_row(docs).alias("row"), F.col("text"))
    return identify(row, model, ["row"]).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
