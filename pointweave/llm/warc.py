"""WARC archives of captures and an external merge of their indexes.

Writing: every capture becomes a record of a gzip-compressed WARC file in the shared folder, `response` with its payload
or `revisit` of the capture that holds the same payload. Each archive also gets an index run, its captures sorted by
(URL key, timestamp, id), in blocks whose first keys are listed at the end of the run.

Merging: the runs are cut at common splitters, and for each range one task streams its part of every run through a loser
tree, so a range's captures come out in order with one comparison for each level, and memory holds one block for each
run. More runs than FAN_IN are first merged in groups to longer runs. Ranges follow each other, so the whole index is in
order and each capture has a global position.

Reading: the merged index, dealt by archive, leads to every record, which is read at its offset and checked against its
payload digest.

Null html counts as empty, null url as the empty URL, null captured_at as the epoch. Of captures with equal payloads of
at least MIN_REVISIT bytes, that with the largest id is the response; smaller payloads are always stored. Ids must be
whole numbers; a null id is stored with its own mark and sorts first. Equal rows give equal records.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import re
import struct
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.bloom import maybe_repeated, repeated_filter
from pointweave.llm.common import filesystem, join_groups, session, shared_uri, ship

#: Payloads below so many bytes are never stored as revisits.
MIN_REVISIT = 1000
#: Captures in an archive; index entries in a block; the most runs merged at once; splitters taken from each run.
ARCHIVE_ROWS, BLOCK_ROWS, FAN_IN, SPLITS_A_RUN = 20_000, 512, 256, 64
GZIP_LEVEL = 1
_EPOCH = "1970-01-01T00:00:00Z"
_URL = re.compile(r"^(?:([a-z][a-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?", re.I)


def url_key(url: str | None) -> str:
    """The sort-friendly key of a URL: host labels reversed, then path and query; scheme, port 80/443 and fragment dropped."""
    _, host, path, query = _URL.match(url or "").groups("")
    host = host.rpartition("@")[2].lower()
    host = re.sub(r":(?:80|443)?$", "", host)
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (path or "/") + query


def record(kind: str, capture: str, url: str, date: str, digest: str, size: int, payload: bytes, refers: tuple[str, str] | None) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:{capture}>", f"WARC-Date: {date}", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers:
        head += [f"WARC-Refers-To: <urn:capture:{refers[0]}>", f"WARC-Refers-To-Target-URI: {re.sub(r'[\r\n]', ' ', refers[1])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    found = dict(x.split(": ", 1) for x in lines[1:])
    size = int(found["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    return found, rest[:size]


# --- index runs -----------------------------------------------------------------------------------------------------

#: An entry is (key, date, capture, archive, offset, length); entries compare by their first three parts, ids by number.
Entry = tuple


def capture_order(capture: str) -> tuple[int, int]:
    return (0, 0) if capture == "null" else (1, int(capture))


def order(e: Entry):
    return e[0], e[1], capture_order(e[2])


class RunWriter:
    """Writes sorted entries as compressed blocks; the listing of blocks, with their first entries' order, goes last."""

    def __init__(self, out):
        self.out, self.rows, self.blocks, self.at, self.n = out, [], [], 0, 0

    def add(self, e: Entry) -> None:
        self.rows.append(e)
        self.n += 1
        if len(self.rows) >= BLOCK_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.rows:
            data = zlib.compress("\n".join("\t".join(map(str, e)) for e in self.rows).encode(), 1)
            self.out.write(data)
            self.blocks.append((self.at, len(data), self.rows[0]))
            self.at += len(data)
            self.rows = []

    def close(self) -> None:
        self._flush()
        listing = zlib.compress("\n".join("\t".join(map(str, (a, n, *e))) for a, n, e in self.blocks).encode(), 1)
        self.out.write(listing)
        self.out.write(struct.pack("<QQ", self.at, len(listing)))
        self.out.close()


def _entry(line: str) -> Entry:
    key, date, capture, archive, offset, length = line.split("\t")
    return key, date, capture, archive, int(offset), int(length)


class Run:
    """A run open for reading."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        at, n = struct.unpack("<QQ", self.file.read_at(16, self.file.size() - 16))
        lines = zlib.decompress(self.file.read_at(n, at)).decode().split("\n")
        parts = [x.split("\t", 2) for x in lines if x]
        self.blocks = [(int(a), int(n), _entry(e)) for a, n, e in parts]

    def stream(self, low, high):
        """The entries from low (or the start, if None) up to but without high (or the end), a block at a time."""
        firsts = [order(e) for _, _, e in self.blocks]
        i = 0 if low is None else max(0, bisect.bisect_right(firsts, low) - 1)
        # entries equal to low may begin in an earlier block than the last whose first is at most low
        while low is not None and i > 0 and firsts[i] == low:
            i -= 1
        for at, n, first in self.blocks[i:]:
            if high is not None and order(first) >= high:
                return
            for line in zlib.decompress(self.file.read_at(n, at)).decode().split("\n"):
                e = _entry(line)
                k = order(e)
                if high is not None and k >= high:
                    return
                if low is None or k >= low:
                    yield k, e


class LoserTree:
    """K-way merge: inner nodes hold the loser of each match, so the next winner needs one match a level on its own path."""

    def __init__(self, streams: list):
        self.streams = streams
        k = self.k = max(1, len(streams))
        self.heads = [next(s, None) for s in streams] or [None]
        self.losers = [-1] * k
        winners = [0] * (2 * k)
        for i in range(k):
            winners[k + i] = i
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._before(b, a):
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x[0], a) < (y[0], b)

    def __iter__(self):
        while (head := self.heads[self.winner]) is not None:
            yield head[1]
            w = self.winner
            self.heads[w] = next(self.streams[w], None)
            node = (w + self.k) // 2
            while node >= 1:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


# --- writing --------------------------------------------------------------------------------------------------------


@dataclass
class Archives:
    """What a write left: the folder, (archive, captures) and (run, entries) by name."""

    uri: str
    archives: list[tuple[str, int]] = field(default_factory=list)
    runs: list[tuple[str, int]] = field(default_factory=list)


def revisits(captures: DataFrame) -> DataFrame:
    """captures (id, url, captured_at, payload binary) with sha, refers_id and refers_url, the last two null for responses.

    Digests that a Bloom filter shows to be unique pass straight through; the others' rows join their group's response."""
    spark = session(captures)
    ship(spark)
    digest = captures.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("_large", F.length("payload") >= MIN_REVISIT)
    slim = digest.where("_large and id is not null").select("id", "url", "sha", F.xxhash64("sha").alias("h"))
    n = captures.count()
    bitmap, bits = repeated_filter(slim, "h", n)
    held = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(h):
        import pandas as pd

        return pd.Series(maybe_repeated(h.to_numpy(), held.value, bits))

    none = [F.lit(None).cast(captures.schema["id"].dataType).alias("refers_id"), F.lit(None).cast("string").alias("refers_url")]
    columns = ["id", "url", "captured_at", "payload", "sha"]
    tested = digest.withColumn("_maybe", F.col("_large") & F.col("id").isNotNull() & maybe(F.xxhash64("sha")))
    alone = tested.where(~F.col("_maybe")).select(*columns, *none)
    groups = slim.where(maybe("h")).groupBy("sha").agg(F.max(F.struct("id", "url")).alias("_r"), F.count(F.lit(1)).alias("_n"))
    shared = join_groups(tested.where("_maybe").select(*columns), groups, ["sha"], "_n", n)
    own = F.col("_r.id") == F.col("id")
    return alone.unionByName(shared.select(*columns, F.when(~own, F.col("_r.id")).alias("refers_id"), F.when(~own, F.col("_r.url")).alias("refers_url")))


def write(captures: DataFrame, uri: str | None = None) -> Archives:
    """Writes captures (id, url, captured_at string in ISO 8601, payload binary) below uri."""
    spark = session(captures)
    uri = uri or shared_uri(spark, "warc")
    fs, folder = filesystem(uri)
    fs.create_dir(folder, recursive=True)
    ready = revisits(captures.select(F.col("id").cast("long").alias("id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("captured_at", F.lit(_EPOCH)).alias("captured_at"), F.coalesce("payload", F.lit(b"")).alias("payload")))

    def run(batches):
        from pointweave.llm import warc

        files, below = filesystem(uri)
        store, entries, at, name = None, [], 0, ""

        def finish():
            store.close()
            entries.sort(key=warc.order)
            w = warc.RunWriter(files.open_output_stream(f"{below}/{name}.idx"))
            for e in entries:
                w.add(e)
            w.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(entries)])], ["name", "n"])

        for b in batches:
            for i in range(b.num_rows):
                if store is None:
                    name, at, entries = uuid.uuid4().hex, 0, []
                    store = files.open_output_stream(f"{below}/{name}.warc.gz", compression=None)
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                capture = "null" if r["id"] is None else str(r["id"])
                again = r["refers_id"] is not None
                data = warc.record(
                    "revisit" if again else "response", capture, r["url"], r["captured_at"], r["sha"].hex(), len(r["payload"]), b"" if again else r["payload"],
                    (str(r["refers_id"]), r["refers_url"]) if again else None,
                )
                packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                data = packer.compress(data) + packer.flush()
                store.write(data)
                entries.append((re.sub(r"[\t\r\n]", "%09", warc.url_key(r["url"])), r["captured_at"], capture, name, at, len(data)))
                at += len(data)
                if len(entries) >= ARCHIVE_ROWS:
                    yield finish()
                    store = None
        if store is not None:
            yield finish()

    rows = ready.mapInArrow(run, "name string, n long").collect()
    return Archives(uri, [(f"{r.name}.warc.gz", r.n) for r in rows], [(f"{r.name}.idx", r.n) for r in rows])


# --- merging --------------------------------------------------------------------------------------------------------


def _shorten(spark: SparkSession, made: Archives) -> list[tuple[str, int]]:
    """Runs that number FAN_IN at most, merged in groups where there are more."""
    runs, uri = made.runs, made.uri
    while len(runs) > FAN_IN:
        groups = [(i, [n for n, _ in runs[i : i + FAN_IN]]) for i in range(0, len(runs), FAN_IN)]

        def merge(batches):
            from pointweave.llm import warc

            fs, folder = filesystem(uri)
            for b in batches:
                for names in b.column("names").to_pylist():
                    name = f"{uuid.uuid4().hex}.idx"
                    w = warc.RunWriter(fs.open_output_stream(f"{folder}/{name}"))
                    for e in warc.LoserTree([warc.Run(fs, f"{folder}/{n}").stream(None, None) for n in names]):
                        w.add(e)
                    w.close()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([w.n])], ["name", "n"])

        df = spark.createDataFrame(groups, "g long, names array<string>").repartition(len(groups), "g")
        runs = [(r.name, r.n) for r in df.mapInArrow(merge, "name string, n long").collect()]
    return runs


def splitters(uri: str, runs: list[tuple[str, int]], ranges: int) -> list:
    """Orders at which the runs are cut, from the first entries of at most SPLITS_A_RUN blocks of each run."""
    fs, folder = filesystem(uri)
    seen = []
    for name, _ in runs:
        blocks = Run(fs, f"{folder}/{name}").blocks
        seen += [order(blocks[i][2]) for i in sorted({int(i) for i in np.linspace(0, len(blocks) - 1, min(SPLITS_A_RUN, len(blocks)))})]
    seen.sort()
    return sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []


def merged(spark: SparkSession, made: Archives, ranges: int | None = None) -> DataFrame:
    """The whole index in order: position (from 0), url_key, date, capture, archive, offset, length.

    Two passes over the ranges: one counts each range's entries from the runs, so that positions are global, one merges."""
    ship(spark)
    runs, uri = _shorten(spark, made), made.uri
    ranges = ranges or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(n for _, n in runs) // 2_000 + 1))
    cuts = splitters(uri, runs, ranges)
    bounds = spark.sparkContext.broadcast((list(zip([None, *cuts], [*cuts, None])), [n for n, _ in runs]))
    schema = "position long, url_key string, date string, capture string, archive string, offset long, length long"

    def merge(batches):
        from pointweave.llm import warc

        fs, folder = filesystem(uri)
        pairs, names = bounds.value
        for b in batches:
            for r, start in zip(b.column("r").to_pylist(), b.column("start").to_pylist()):
                tree, rows = warc.LoserTree([warc.Run(fs, f"{folder}/{n}").stream(*pairs[r]) for n in names]), []
                for e in tree:
                    rows.append(e)
                    if len(rows) == 4096:
                        yield batch(rows, start)
                        start, rows = start + len(rows), []
                if rows:
                    yield batch(rows, start)

    def batch(rows, start):
        return pa.RecordBatch.from_arrays(
            [pa.array(range(start, start + len(rows)), pa.int64()), *(pa.array(c, pa.string()) for c in list(zip(*rows))[:4]), *(pa.array(c, pa.int64()) for c in list(zip(*rows))[4:])],
            ["position", "url_key", "date", "capture", "archive", "offset", "length"],
        )

    def count(batches):
        from pointweave.llm import warc

        fs, folder = filesystem(uri)
        pairs, names = bounds.value
        for b in batches:
            for r in b.column("r").to_pylist():
                n = sum(1 for name in names for _ in warc.Run(fs, f"{folder}/{name}").stream(*pairs[r]))
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([n], pa.int64())], ["r", "n"])

    numbers = [(r, 0) for r in range(len(cuts) + 1)]
    deal = lambda rows: spark.createDataFrame(rows, "r long, start long").repartitionByRange(len(rows), "r")
    sizes = {r.r: r.n for r in deal(numbers).mapInArrow(count, "r long, n long").collect()}
    starts = np.r_[0, np.cumsum([sizes.get(r, 0) for r, _ in numbers])]
    return deal([(r, int(starts[r])) for r, _ in numbers]).mapInArrow(merge, schema)


# --- reading --------------------------------------------------------------------------------------------------------


def read(spark: SparkSession, made: Archives, index: DataFrame) -> DataFrame:
    """Every capture of the merged index from its archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, position."""
    ship(spark)
    uri = made.uri

    def run(batches):
        from pointweave.llm import warc

        fs, folder = filesystem(uri)
        name, file = None, None
        for b in batches:
            out = []
            for position, key, archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("position", "url_key", "archive", "offset", "length"))):
                if archive != name:
                    name, file = archive, io.BufferedReader(fs.open_input_file(f"{folder}/{archive}.warc.gz"), 1 << 20)
                file.seek(offset)
                head, content = warc.parse(zlib.decompress(file.read(length), 31))
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(head["X-Payload-Length"])
                if kind == "response" and (len(content) != size or hashlib.sha1(content).hexdigest() != digest):
                    raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                number = lambda h: None if (x := head[h][len("<urn:capture:") : -1]) == "null" else int(x)
                out.append((number("WARC-Record-ID"), size, digest, kind, number("WARC-Refers-To") if kind == "revisit" else None, key, position))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position"])

    dealt = index.repartition(max(1, min(len(made.archives), int(spark.conf.get("spark.sql.shuffle.partitions")))), "archive").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, position long")


#: Seconds from 2024 on to which captures' times are kept, so that years have four digits; captures beyond go by id alone.
_FIRST, _LAST = -62_000_000_000, 250_000_000_000


def pages_as_captures(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as captures, one second apart from 2024 on in the order of page_id (any whole number)."""
    second = F.least(F.greatest(F.coalesce(F.col("page_id"), F.lit(0)).cast("long"), F.lit(_FIRST)), F.lit(_LAST))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + second), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pages.select(F.col("page_id").alias("id"), "url", at.alias("captured_at"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
