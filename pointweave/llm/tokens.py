"""Token-id files with a shared zstandard dictionary and an offset index for single documents.

A dictionary is trained on the serialized id arrays of a bounded sample and stored beside the data. Each document's ids,
in ascending doc_id order, are compressed on their own with it. A file is

    "TKZ1"  |  SHA-256 of the dictionary  |  bytes an id  |  one zstandard frame for each document  |  index  |  footer

where the index has doc_id, whether it is null, frame offset, frame length and number of ids for each document, and the
footer the index's offset, the number of documents and the number of ids. A document is read with its index entry and
one short read. Files follow each other in doc_id order; the manifest lists them.

Null text counts as empty and has only the end id. Null doc_ids come first, equal doc_ids are ordered by text.
A file belongs to the attempt that wrote it: its name is new for each attempt and reaches the manifest only with the
task's success, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.bpe import LONG, byte_chars, narrow, parts
from pointweave.llm.common import filesystem, sampled, session, shared_uri, ship

MAGIC = b"TKZ1"
HEADER, FOOTER = "<4s32sB", "<QQQ4s"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n", "<u8")])
#: About so many documents train the dictionary; the dictionary's size; compression level.
SAMPLE_ROWS, DICTIONARY_BYTES, LEVEL = 2_000, 1 << 16, 3
#: Longer texts train no dictionary: it is for short documents, and the driver holds all that train it.
SAMPLE_BYTES = 1 << 14
#: The most pieces in each of a worker's two generations, the longest that is kept, and texts looked at together.
CACHE_PIECES, CACHE_LENGTH, TOGETHER = 200_000, 48, 256
#: Bytes written or read at once.
STEP = 1 << 22

_WORDS = re.compile(r"[^ \t\n\r]+").findall
_RARE = re.compile("[^\x00-\u012f]")


class Pieces(dict):
    """The ids of pieces, encoded on first sight. A full one's pieces become the old ones, from which those still in use move back."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = self.encode(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids (little-endian unsigned 32-bit) of texts by the tokenizers library, which sees each piece of text once.

    For tokenizers that drop white space, a text's ids are those of its words in order. Where the file also lower-cases,
    splits by a pattern and maps bytes to characters, and the text has only characters that lower-case singly and none
    that composes, the pattern's pieces stand for words: they are fewer, and the library's model takes them directly."""

    def __init__(self, tokenizer_json: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(tokenizer_json)
        self.probes = [t["content"][:2] for t in spec["added_tokens"]]
        self.whole = not self._drops_space()
        self.find = None if self.whole else self._pattern(spec)
        self.words = Pieces(self._word)
        model, table = self.tokenizer.model, {b: ord(c) for c, b in byte_chars().items()}
        self.pieces = Pieces(lambda p: array("I", [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(table))]).tobytes())

    def _word(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _drops_space(self) -> bool:
        ids = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        return ids(" a\tb\n") == ids("a") + ids("b") and ids(" \r\n\t") == []

    @staticmethod
    def _pattern(spec: dict):
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if steps != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or not split.get("invert") or split.get("behavior") != "Removed":
            return None
        if [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest if r["type"] == "ByteLevel"] != [("ByteLevel", False, False)] or len(rest) != 1 or sys.byteorder != "little":
            return None
        return re.compile(narrow(re.sub(r"\[(\\p\{[LN]\})\]", r"\1", split["pattern"]["Regex"]))).findall

    def _ids(self, text: str) -> bytes:
        if self.whole:
            return self._word(text)
        if self.find is None or any(p in text for p in self.probes) or _RARE.search(text):
            return b"".join(map(self.words.__getitem__, _WORDS(text)))
        return b"".join(map(self.pieces.__getitem__, self.find(text.lower())))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(map(self._ids, parts(t))) if t and len(t) > LONG and not self.whole else self._ids(t or "") for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """The encoder of a tokenizer file's text, made once for each process."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


@dataclass
class Manifest:
    """The files of a write in order: (path, documents, ids); uri: their folder; dictionary: its bytes."""

    uri: str
    dictionary: bytes
    files: list[tuple[str, int, int]]


def _serial(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def train_dictionary(docs: DataFrame, tokenizer_json: str, end_id: int, width: int) -> bytes:
    """A dictionary from a bounded sample; empty if there is too little to learn from."""
    import zstandard

    w = encoder(tokenizer_json)
    rows = sampled(docs.select("doc_id", "text"), "doc_id", SAMPLE_ROWS, 13).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    samples = [_serial(w.ids([r.text])[0] + struct.pack("<I", end_id), width) for r in rows.select("text").collect()]
    _encoders.clear()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, end_id: int, uri: str | None = None) -> Manifest:
    """Encodes every text with the tokenizer file at path, appends end_id, and writes the files below uri."""
    spark = session(docs)
    ship(spark)
    tokenizer_json = open(path, encoding="utf-8").read()
    width = 2 if max(encoder(tokenizer_json).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    uri = uri or shared_uri(spark, "token-files")
    fs, folder = filesystem(uri)
    fs.create_dir(folder, recursive=True)
    dictionary = train_dictionary(docs, tokenizer_json, end_id, width)
    with fs.open_output_stream(f"{folder}/dictionary") as out:
        out.write(dictionary)
    held = spark.sparkContext.broadcast((tokenizer_json, dictionary))
    end = struct.pack("<I", end_id)

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        from pointweave.llm import tokens

        tokenizer, zdict = held.value
        w = tokens.encoder(tokenizer)
        shared = zstandard.ZstdCompressionDict(zdict) if zdict else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        name, store, at = f"{uuid.uuid4().hex}.tkz", None, 0
        index: list[np.ndarray] = []
        total = 0
        for b in batches:
            if store is None:
                files, below = filesystem(uri)
                store = files.open_output_stream(f"{below}/{name}")
                at = struct.calcsize(HEADER)
                store.write(struct.pack(HEADER, MAGIC, hashlib.sha256(zdict).digest(), width))
            ids = b.column("doc_id")
            texts = b.column("text")
            part = np.zeros(b.num_rows, INDEX)
            part["null"] = ids.is_null().to_numpy(zero_copy_only=False)
            part["doc_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            held_back: list[bytes] = []
            for i in range(0, b.num_rows, TOGETHER):
                for k, got in enumerate(w.ids(texts.slice(i, TOGETHER).to_pylist()), i):
                    frame = packer.compress(_serial(got + end, width))
                    n = len(got) // 4 + 1
                    part["offset"][k], part["length"][k], part["n"][k] = at, len(frame), n
                    at += len(frame)
                    total += n
                    held_back.append(frame)
                store.write(b"".join(held_back))
                held_back.clear()
            index.append(part)
        if store is not None:
            entries = np.concatenate(index)
            store.write(entries.tobytes())
            store.write(struct.pack(FOOTER, at, len(entries), total, MAGIC))
            store.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([name]), pa.array([len(entries)]), pa.array([total])], ["part", "name", "docs", "ids"])

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = placed.mapInArrow(run, "part long, name string, docs long, ids long").collect()
    return Manifest(uri, dictionary, [(r.name, r.docs, r.ids) for r in sorted(rows, key=lambda r: r.part)])


class File:
    """One file, open for reading: entries has the index; ids(i) reads the document at index position i."""

    def __init__(self, uri: str, name: str, dictionary: bytes):
        import zstandard

        fs, folder = filesystem(uri)
        self.file = fs.open_input_file(f"{folder}/{name}")
        magic, digest, self.width = struct.unpack(HEADER, self.file.read_at(struct.calcsize(HEADER), 0))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name}: not written with this dictionary")
        size = self.file.size()
        at, n, self.total, _ = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        self.entries = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.unpacker.decompress(frame, max_output_size=n * self.width), "<u2" if self.width == 2 else "<u4").astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        e = self.entries[i]
        return self._ids(self.file.read_at(int(e["length"]), int(e["offset"])), int(e["n"]))

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document with that doc_id, or None."""
        first = int(self.entries["null"].sum())
        i = first + int(np.searchsorted(self.entries["doc_id"][first:], doc_id))
        return self.ids(i) if i < len(self.entries) and self.entries["doc_id"][i] == doc_id else None

    def spans(self):
        """Yields (first, arrays of ids) for runs of neighbouring documents, each run read at once."""
        i = 0
        while i < len(self.entries):
            start = int(self.entries["offset"][i])
            j = i + int(max(1, np.searchsorted(self.entries["offset"][i:] + self.entries["length"][i:], start + STEP, "right")))
            end = int(self.entries["offset"][j - 1]) + int(self.entries["length"][j - 1])
            data = self.file.read_at(end - start, start)
            yield i, [self._ids(data[int(e["offset"]) - start : int(e["offset"]) - start + int(e["length"])], int(e["n"])) for e in self.entries[i:j]]
            i = j


def read(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; start counts the ids of all before it."""
    ship(spark)
    rows, base = [], 0
    for name, _, ids in manifest.files:
        rows.append((name, base))
        base += ids
    uri, held = manifest.uri, spark.sparkContext.broadcast(manifest.dictionary)

    def run(batches):
        from pointweave.llm import tokens

        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                file = tokens.File(uri, name, held.value)
                for first, arrays in file.spans():
                    entries = file.entries[first : first + len(arrays)]
                    n = np.array([len(a) for a in arrays], np.int64)
                    starts = start + np.cumsum(n) - n
                    start += int(n.sum())
                    crc = np.array([zlib.crc32(a.tobytes()) for a in arrays], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(entries["doc_id"], mask=entries["null"].astype(bool)), pa.array(starts), pa.array(n), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    files = spark.createDataFrame(rows, "name string, start long").repartition(max(1, min(len(rows), 4096)), "name")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
