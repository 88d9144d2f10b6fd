"""Byte-level BPE by the backtracking encoder, and decoding by an offset table.

The encoder follows the published idea that token pairs have a compatibility of their own (as in GitHub's open-source
bpe crate and its article "So many tokens, so little time"); the code here is written for numpy and Python.

Encoding a piece of text: an Aho-Corasick automaton over all tokens gives the longest token at every position in one
pass; tokens are then laid down from the left. A token may follow another only if the pair is compatible, i.e. BPE's own
merges of the two would leave exactly these two; that is decided by undoing the merges across the border. When no token
fits, the encoder goes back to the next shorter token that is a prefix, and each end position is given up at most once,
so the work is linear in the piece. The result equals merging pairs by rank.

Texts are split into pieces as the tokenizer file says (special tokens first, then its pattern). The pieces of texts in
which a character is unassigned in Unicode 15.1 come from the library's own splitter, whose Unicode version may differ
from that of the pattern's engine. Pieces are cached within bounds, so common words are encoded once for each task; nothing outlives it.

Null text counts as empty and has no token. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import lean, session, ship

#: The splitting pattern of byte-level BPE files whose pre-tokenizer is ByteLevel with use_regex (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most pieces in each of a task's two generations, and the longest piece that is kept.
CACHE_PIECES, CACHE_LENGTH = 100_000, 48
#: Tokens decoded at once, and characters of a text split into pieces at once.
DECODE_STEP, LONG = 1 << 16, 1 << 20

_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")


def byte_chars() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tables:
    """The merges of a tokenizer file, with tokens numbered by rank: the bytes first, then merge by merge."""

    def __init__(self, tokenizer_json: str):
        self.json = tokenizer_json
        spec = json.loads(tokenizer_json)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("not a byte-level BPE file")
        vocab, chars = spec["model"]["vocab"], byte_chars()
        rank: dict[str, int] = {c: i for i, c in enumerate(sorted(chars, key=chars.get))}
        self.tokens: list[bytes] = [bytes([i]) for i in range(256)]
        self.split: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.pair: dict[int, int] = {}
        ids = [vocab[c] for c in rank]
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, new = rank[a], rank[b], len(self.tokens)
            self.pair[left << 32 | right] = new
            if a + b not in rank:
                rank[a + b] = new
            self.tokens.append(self.tokens[left] + self.tokens[right])
            self.split.append((left, right))
            ids.append(vocab[a + b])
        self.out = [int(i).to_bytes(4, "little") for i in ids]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_bytes: dict[bytes, int] = {}
        for i, t in enumerate(self.tokens):
            by_bytes.setdefault(t, i)
        self.shorter = [-1] * len(self.tokens)
        for t, i in by_bytes.items():
            for n in range(len(t) - 1, 0, -1):
                if (p := by_bytes.get(t[:n])) is not None:
                    self.shorter[i] = p
                    break
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t, i in by_bytes.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.tokens]
        # decoding: all tokens' bytes in one array, and where each id's begin
        size = max([*ids, *self.added.values()]) + 1
        text = [b""] * size
        for i, t in zip(ids, self.tokens):
            text[i] = t
        for s, i in self.added.items():
            text[i] = s.encode()
        self.width = np.array([len(t) for t in text], np.int64)
        self.offset = np.r_[0, np.cumsum(self.width)[:-1]]
        self.bytes = np.frombuffer(b"".join(text), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b side by side: no merge across their border comes before those that made them."""
        limit, pair, split = 1 << 40, self.pair, self.split
        while True:
            if (new := pair.get(a << 32 | b)) is not None and new < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> bytes:
        """The ids of one piece as little-endian unsigned 32-bit integers."""
        n, length = len(piece), self.length
        longest = [0] * n
        best = [0] * n
        for end, t in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - length[t]
            if length[t] > best[start]:
                best[start], longest[start] = length[t], t
        ends = bytearray(b"\x01") * (n + 1)
        laid: list[int] = []
        pos, token = 0, longest[0] if n else -1
        while pos < n:
            last = laid[-1] if laid else -1
            while True:
                end = pos + length[token]
                if ends[end] and (last < 0 or self.compatible(last, token)):
                    laid.append(token)
                    pos = end
                    token = longest[pos] if pos < n else -1
                    break
                if (shorter := self.shorter[token]) >= 0:
                    token = shorter
                else:
                    ends[pos] = 0
                    laid.pop()
                    pos -= length[last]
                    token = last
                    break
        return b"".join([self.out[t] for t in laid])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered through the offset table."""
        out = []
        for i in range(0, len(ids), DECODE_STEP):
            part = ids[i : i + DECODE_STEP]
            width = self.width[part]
            ends = np.cumsum(width)
            at = np.repeat(self.offset[part] - (ends - width), width) + np.arange(int(ends[-1]))
            out.append(self.bytes[at].tobytes())
        return b"".join(out)


class Pieces(dict):
    """The ids of pieces of text, encoded on first sight. When it is full, its pieces become the old ones, from which
    those still in use move back."""

    def __init__(self, tables: Tables):
        self.tables, self.old = tables, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = self.tables.encode_piece(piece.encode())
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def parts(text: str):
    """A long text in parts of bounded length, cut before single spaces, where pieces and words end anyway."""
    at = 0
    while len(text) - at > LONG and (m := _CUT.search(text, at + LONG)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def narrow(pattern: str) -> str:
    """The pattern for texts of code points below U+0300, its classes spelt out for the faster engine of the standard library."""
    import regex

    def chars(kind: str) -> str:
        return "".join(f"\\u{i:04x}" for i in range(0x300) if regex.fullmatch(kind, chr(i)))

    letter, number, space = chars(r"\p{L}"), chars(r"\p{N}"), chars(r"\s")
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return pattern.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


class Codec:
    def __init__(self, tokenizer_json: str):
        import regex

        self.tables = Tables(tokenizer_json)
        self.pieces = Pieces(self.tables)
        self.find = regex.compile(PATTERN).findall
        self.find_common = re.compile(narrow(PATTERN)).findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.tables.added, key=len, reverse=True))) + ")") if self.tables.added else None
        self.probe = [s[:2] for s in self.tables.added]
        self.rare = re.compile("[^\x00-˿]")
        self.unassigned = None
        self.splitter = None

    def split(self, text: str) -> list[str]:
        if self.rare.search(text):
            if self.unassigned is None:
                runs, start = [], None
                for i in range(0x300, sys.maxunicode + 2):
                    no = i <= sys.maxunicode and unicodedata.category(chr(i)) == "Cn"
                    if no and start is None:
                        start = i
                    elif not no and start is not None:
                        runs.append(f"\\U{start:08x}-\\U{i - 1:08x}")
                        start = None
                self.unassigned = re.compile("[" + "".join(runs) + "]")
            if self.unassigned.search(text):
                if self.splitter is None:
                    from tokenizers import Tokenizer

                    self.splitter = Tokenizer.from_str(self.tables.json).pre_tokenizer
                return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
            return self.find(text)
        return self.find_common(text)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.special is None or not any(p in text for p in self.probe):
            return b"".join(b"".join(map(self.pieces.__getitem__, self.split(part))) for part in parts(text))
        out = []
        for part in self.special.split(text):
            if part in self.tables.added:
                out.append(self.tables.added[part].to_bytes(4, "little"))
            elif part:
                out.extend(b"".join(map(self.pieces.__getitem__, self.split(p))) for p in parts(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.tables.decode(np.frombuffer(ids, "<u4")).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def release() -> None:
    """Lets go of all codecs. Workers outlive their tasks and go on to other operators, which need the memory."""
    _codecs.clear()


def codec(tokenizer_json: str) -> Codec:
    """The codec of a tokenizer file's text, made once for each process, or until release()."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(tokenizer_json)
    return _codecs[key]


def encode(docs: DataFrame, path: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of the text as binary, little-endian unsigned 32-bit. path: a tokenizer file, read on the driver."""
    spark = session(docs)
    ship(spark)
    held = spark.sparkContext.broadcast(open(path, encoding="utf-8").read())

    @F.pandas_udf("binary", F.PandasUDFType.SCALAR_ITER)
    def run(batches):
        from pointweave.llm import bpe

        c = bpe.codec(held.value)
        try:
            for texts in batches:
                yield texts.map(lambda t: c.encode(t) if t else b"")
        finally:
            bpe.release()

    return docs.withColumn(ids, run(F.col(column)))


def decode(docs: DataFrame, path: str, ids: str = "ids", column: str = "text") -> DataFrame:
    """docs with the text of the token ids in the binary column ids; null gives the empty text."""
    spark = session(docs)
    ship(spark)
    held = spark.sparkContext.broadcast(open(path, encoding="utf-8").read())

    @F.pandas_udf("string", F.PandasUDFType.SCALAR_ITER)
    def run(batches):
        from pointweave.llm import bpe

        c = bpe.codec(held.value)
        try:
            for found in batches:
                yield found.map(lambda i: c.decode(i) if i else "")
        finally:
            bpe.release()

    return docs.withColumn(column, run(F.col(ids)))


def round_trip(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns in keep, ids, n_tokens, and whether the ids decode to the text again; one worker does both ways."""
    spark = session(docs)
    ship(spark)
    held = spark.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def run(batches):
        from pointweave.llm import bpe

        c = bpe.codec(held.value)
        try:
            for b in batches:
                ids, exact = [], []
                for t in b.column("_text"):
                    text = t.as_py() or ""
                    ids.append(c.encode(text))
                    exact.append(c.decode(ids[-1]) == text)
                n = pa.array([len(i) // 4 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(ids, pa.binary()), n, pa.array(exact, pa.bool_())], [*keep, "ids", "n_tokens", "exact"])
        finally:
            bpe.release()

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(lean(run), f"{schema}, ids binary, n_tokens long, exact boolean")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids."""
    spark = session(docs)
    ship(spark)
    held = spark.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def run(batches):
        from pointweave.llm import bpe

        c = bpe.codec(held.value)
        try:
            for b in batches:
                n, ids_sha, text_sha = [], [], []
                for t in b.column("text"):
                    ids = c.encode(t.as_py() or "")
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            bpe.release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
