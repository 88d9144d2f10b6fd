"""Exact Jaccard self-join of word-shingle sets, by partitioning the universe of shingles.

Two sets of a and b shingles reach similarity 3/4 only if their symmetric difference D is at most H = (a + b) / 7. Sets
are put in size bands; in a band's scheme a hash cuts the universe into m segments, and by the pigeonhole principle two
similar sets agree on most segments. A signature is the hash of a set's part of one segment. Per band one of two
allocations is used, whichever a bounded sample of the sets shows to cost less:

  whole segments   m > H segments, each with its signature; at least m - H segments are equal;
  one deletion     m > H / 2 segments, each with its signature and those of the part less one shingle; at least
                   m - H / 2 segments differ in at most one shingle.

Empty parts would agree for no reason, so they give no signature; m has slack for them, and the few sets with more empty
parts than the slack allows also give signatures for these, which meet only among such sets. So no pair is lost.

Equal sets are one class and take part once. Signatures are dealt by their leading bits. Similar classes share not just
one signature: at least m - H (or m - H / 2) less the empty parts. So where a signature has up to FEW classes all its
pairs are counted, and a pair whose count, with what signatures of more classes could add, reaches this bound is an edge.
Signatures with more classes are not paired. A class that could reach its bound by these alone takes them from the rarest
on; two such classes that share enough share one of the first h - bound + 1, so edges from the class to the least class
of each of these bring all its possible partners into one component. Within such a component, in tiles, the signatures
that classes share are counted, and a spanning forest of the pairs that reach the bound gives further edges. The
components of all edges are families: every pair of similar classes lies in one, and no group has given more edges than
members.

Families are verified on the full sets, in tiles of bounded size. A tile counts all its pairs' common shingles at once
and lets out a spanning forest of the similar ones. A family of one tile is done with that. The classes of a larger one
are dealt into blocks by hash, each together with the family's hubs (the classes with most shared signatures of each
band), which leaves few components; then only pairs of blocks that hold different components meet. So the result is the
exact set of components, and what leaves a task is in proportion to the members of a group and never to its pairs.

A text's words, shingles and edge cases: A-Z count as a-z; words are runs of bytes other than space and \\x09-\\x0D; fewer
than five words are one shingle; null, empty and blank texts have no shingle, are linked with nothing and keep their own
doc_id. Rows with equal doc_id count as separate documents with the same id; a null doc_id has a null component unless
linked with others. doc_id must be an integer or its text: other values raise. Only doc_id and text are read. Classes
are told apart by 128 bits; candidates go by the first 64, where a collision can only add candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.bloom import maybe_repeated, mix, repeated_filter
from pointweave.llm.common import join_groups, lean, session, ship, whole_row, written
from pointweave.llm.components import components
from pointweave.llm.wordhash import word_hashes

WORDS = 5
#: Sets taken at most (about) to choose each band's allocation, the most shingles of one, and a pair's cost in signatures.
#: Bands of larger sets use whole segments.
SAMPLE_SETS, SAMPLE_SIZE, PAIR_COST = 3_000, 1 << 12, 64
#: Signatures aimed at in a bucket, and held back on the map side at once.
BUCKET_ROWS, FLUSH = 100_000, 400_000
#: Signatures with more classes are not paired.
FEW = 8
#: Classes and shingles aimed at in a block of a family, and cells of a matrix in a tile.
BLOCK, BLOCK_SHINGLES, CELLS = 768, 1 << 20, 1 << 22

_U = np.uint64
_C = [_U(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_K1, _K2, _KV, _KS, _KB = (_U(k) for k in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165))


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a document's word hashes."""
    if not len(words):
        return words
    if len(words) < WORDS:
        own = words * np.array(_C[: len(words)], _U)
        return mix(np.array([own.sum(dtype=_U)], _U) + np.array([len(words)], _U) * _KB)
    n = len(words) - WORDS + 1
    h = words[:n] * _C[0]
    for k in range(1, WORDS):
        h = h + words[k : k + n] * _C[k]
    return np.unique(mix(h))


def set_keys(t: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, as signed integers."""
    a = int(mix(np.array([np.sum(mix(t ^ _K1), dtype=_U)], _U) + np.array([len(t)], _U)).view(np.int64)[0])
    b = int(mix(np.array([np.sum(mix(t ^ _K2), dtype=_U)], _U) + np.array([len(t)], _U)).view(np.int64)[0])
    return a, b


def sets(texts: list[bytes | None]):
    """Yields (position, sorted shingle hashes) of every text."""
    for first, words, _, offsets in word_hashes(texts):
        for i in range(len(offsets) - 1):
            yield first + i, shingles(words[offsets[i] : offsets[i + 1]])


# --- bands and allocations ------------------------------------------------------------------------------------------


def edges(most: int = 1 << 40) -> list[int]:
    """The least sizes of the bands; a similar set at most 4/3 as large is in the same band or the next."""
    out = [3]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 16 // 9))
    return out


_EDGES = edges()


def reach(n: int) -> int:
    """The largest symmetric difference of a set of n shingles to a similar one."""
    return (n + 4 * n // 3) // 7


def band(n: int) -> int:
    return int(np.searchsorted(_EDGES, n, "right")) - 1


def schemes(n: int) -> list[int]:
    """The bands in whose schemes a set of n shingles takes part: its own, and the one below if it may have a partner there."""
    if n < 3:
        return []
    j = band(n)
    return [j, j - 1] if j > 0 and -(-3 * n // 4) < _EDGES[j] else [j]


def segments(j: int, deletion: bool) -> int:
    """How many segments the scheme of band j has."""
    h = reach(_EDGES[j + 1] - 1)
    if deletion:
        return h // 2 + 1 + max(1, int(0.02 * h + 0.3 * h**0.5))
    return h + 1 + max(1, int(0.1 * h + 0.6 * h**0.5))


def empty_parts(t: np.ndarray, j: int, deletion: bool) -> int:
    """How many segments of band j's scheme have no shingle of a set, or, with deletions, at most one."""
    m = segments(j, deletion)
    segment = ((t >> _U(32)) * _U(m)) >> _U(32)
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    return m - (int((np.diff(np.r_[first, len(t)]) > 1).sum()) if deletion else len(first))


def signatures(t: np.ndarray, j: int, deletion: bool) -> np.ndarray:
    """The signatures of a set in the scheme of band j, which their last six bits name."""
    n, m = len(t), segments(j, deletion)
    h = min(reach(n), reach(_EDGES[j + 1] - 1))
    value = mix(t ^ _KV)
    segment = ((t >> _U(32)) * _U(m)) >> _U(32)  # tokens are sorted, so those of a segment stand together
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    ids = segment[first]
    scheme = np.array([j * 2 + deletion], _U) * _KB
    base = ids * _KS + scheme
    total = np.add.reduceat(value, first)
    out = [mix(total + base)]
    size = np.diff(np.r_[first, n])
    if deletion:
        at = np.repeat(np.arange(len(first)), size)
        more = size[at] > 1
        out.append(mix(total[at[more]] - value[more] + base[at[more]]))
        tiny = m - int((size > 1).sum())
        thin = tiny >= m - h // 2
    else:
        thin = m - len(first) >= m - h
    if thin:
        lone = np.ones(m, bool)
        lone[ids[size > 1] if deletion else ids] = False
        out.append(mix(np.flatnonzero(lone).astype(_U) * _KS + scheme))
    return np.concatenate(out) & ~_U(63) | _U(j)


def allocate(sample: list[np.ndarray], total: int) -> dict[int, bool]:
    """For each band whether its scheme uses deletions, by signatures plus the candidates that the sample foretells."""
    out: dict[int, bool] = {}
    by: dict[int, list[np.ndarray]] = {}
    for t in sample:
        for j in schemes(len(t)):
            by.setdefault(j, []).append(t)
    scale = max(1.0, total / max(1, len(sample)))
    for j, held in by.items():
        cost = []
        for deletion in (False, True):
            s = np.concatenate([np.unique(signatures(t, j, deletion)) for t in held])
            cost.append(len(s) + PAIR_COST * scale * (len(s) - len(np.unique(s))) / max(1, len(held)))
        out[j] = cost[1] < cost[0]
    return out


# --- stages ---------------------------------------------------------------------------------------------------------


def _slim(docs: DataFrame, plan: dict[int, bool]) -> DataFrame:
    """doc_id, n, key, check, band, and the empty parts e0 and e1 in the schemes of that band and of the one below."""

    def run(batches):
        from pointweave.llm import jaccard

        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            found = np.zeros((6, len(texts)), np.int64)
            for i, t in jaccard.sets(texts):
                if len(t):
                    js = jaccard.schemes(len(t))
                    e = [jaccard.empty_parts(t, j, plan.get(j, False)) for j in js]
                    found[:, i] = (len(t), *jaccard.set_keys(t), js[0] if js else -1, *(e + [0, 0])[:2])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, found)], ["doc_id", "n", "key", "check", "band", "e0", "e1"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n long, key long, check long, band long, e0 long, e1 long")


def _sampled_sets(docs: DataFrame, rows: int) -> list[np.ndarray]:
    def run(batches):
        from pointweave.llm import jaccard

        for b in batches:
            for _, t in jaccard.sets(b.column("text").cast(pa.binary()).to_pylist()):
                if 2 < len(t) <= jaccard.SAMPLE_SIZE:
                    yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary())], ["t"])

    share = min(1.0, SAMPLE_SETS / max(1, rows))
    picked = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.lit(14)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return [np.frombuffer(r.t, _U) for r in picked.select("text").mapInArrow(lean(run), "t binary").collect()]


def _signed(docs: DataFrame, plan: dict[int, bool], buckets: int) -> DataFrame:
    """bucket, sigs, keys: signatures as packed arrays; within a task's flush, equal sets sign once."""
    shift = 64 - (buckets.bit_length() - 1)

    def run(batches):
        from pointweave.llm import jaccard

        held, keys, n, seen = [], [], 0, set()

        def flush():
            s = np.concatenate(held)
            k = np.repeat(np.array(keys, np.int64), [len(x) for x in held])
            bucket = (s >> _U(shift)).astype(np.int64) if shift < 64 else np.zeros(len(s), np.int64)
            by = np.argsort(bucket, kind="stable")
            s, k, bucket = s[by], k[by], bucket[by]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[first[1:], len(s)]
            low = s.view(np.uint8).reshape(-1, 8)[:, :6]  # the bucket has the leading bits; six bytes tell the rest apart
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[first]), pa.array([np.ascontiguousarray(low[a:b]).tobytes() for a, b in zip(first, ends)], pa.binary()), pa.array([k[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())],
                ["bucket", "sigs", "keys"],
            )

        for b in batches:
            for _, t in jaccard.sets(b.column("text").cast(pa.binary()).to_pylist()):
                if len(t) < 3:
                    continue
                key = jaccard.set_keys(t)[0]
                if key in seen:
                    continue
                seen.add(key)
                s = np.unique(np.concatenate([jaccard.signatures(t, j, plan.get(j, False)) for j in jaccard.schemes(len(t))]))
                held.append(s)
                keys.append(key)
                n += len(s)
                if n >= FLUSH:
                    yield flush()
                    held, keys, n = [], [], 0
                    seen.clear()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(lean(run), "bucket long, sigs binary, keys binary")


def _count_pairs(s: np.ndarray, k: np.ndarray):
    """Of the signatures s with classes k, sorted: rows (a, b, scheme, signatures shared) of those with FEW classes at
    most, and rows (signature, class, scheme, classes of the signature, the least of them) of the others."""
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[first, len(s)])
    pairs = []
    for n in range(2, FEW + 1):
        at = first[size == n]
        for x in range(n - 1):
            for y in range(x + 1, n):
                pairs.append(np.stack([k[at + x], k[at + y], (s[at] & _U(63)).astype(np.int64)]))
    pairs = np.concatenate(pairs, 1)
    by = np.lexsort(pairs)
    pairs = pairs[:, by]
    if pairs.shape[1]:
        fresh = np.flatnonzero(np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(0)])
        pairs = np.concatenate([pairs[:, fresh], np.diff(np.r_[fresh, pairs.shape[1]])[None]])
    else:
        pairs = np.zeros((4, 0), np.int64)
    many = np.repeat(size, size) > FEW
    of = lambda x: np.repeat(x, size)[many].astype(np.int64)
    return pairs, np.stack([mix(s[many]).view(np.int64), k[many], (s[many] & _U(63)).astype(np.int64), of(size), of(k[first])])


def _met(signed: DataFrame, parts: int) -> DataFrame:
    """For pairs: a, b, scheme, n = the signatures shared (to be summed), grp null. For signatures with more than FEW
    classes: grp, a, b = the least of its classes, scheme, n = its classes."""

    def run(batches):
        from pointweave.llm import jaccard

        def done():
            raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, 6)
            s = np.zeros((len(raw), 8), np.uint8)
            s[:, :6] = raw
            s = s.view(_U).ravel()
            k = np.frombuffer(b"".join(keys), np.int64)
            by = np.lexsort((k, s))
            s, k = s[by], k[by]
            fresh = np.r_[True, (s[1:] != s[:-1]) | (k[1:] != k[:-1])]
            return jaccard._count_pairs(s[fresh], k[fresh])

        def out(bucket, pairs, hot):
            no = np.r_[np.ones(pairs.shape[1], bool), np.zeros(hot.shape[1], bool)]
            grp = mix((hot[0] ^ np.int64(bucket)).view(_U)).view(np.int64)
            columns = [np.r_[pairs[0], hot[1]], np.r_[pairs[1], hot[4]], np.r_[pairs[2], hot[2]], np.r_[pairs[3], hot[3]]]
            return pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(pairs.shape[1], np.int64), grp], mask=no), *map(pa.array, columns)], ["grp", "a", "b", "scheme", "n"])

        now, sigs, keys = None, [], []
        for batch in batches:
            for bucket, s, k in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sigs", "keys"))):
                if bucket != now and sigs:
                    yield out(now, *done())
                    sigs, keys = [], []
                now = bucket
                sigs.append(s)
                keys.append(k)
        if sigs:
            yield out(now, *done())

    return signed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "grp long, a long, b long, scheme long, n long")


def _bound(plan: dict[int, bool], scheme, sizes_sum, empty):
    """The fewest signatures that two similar sets of that scheme share, at least one."""
    m = F.array(*(F.lit(segments(j, plan.get(j, False))) for j in range(len(_EDGES) - 1)))
    part = F.array(*(F.lit(2 if plan.get(j, False) else 1) for j in range(len(_EDGES) - 1)))
    at = scheme.cast("int")
    return F.greatest(F.lit(1), F.get(m, at) - F.floor(F.floor(sizes_sum / 7) / F.get(part, at)) - empty)


def _similar_sizes(x: str, y: str):
    return 4 * F.least(x, y) >= 3 * F.greatest(x, y)


def _sides(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """pairs with the columns of info for a (with suffix _a) and for b, of similar sizes and in the smaller one's scheme."""
    for side in ("a", "b"):
        pairs = pairs.join(info.select(*(F.col(c).alias(f"{c}_{side}" if c != "key" else side) for c in info.columns)), side)
    own = F.when(F.col("n_a") <= F.col("n_b"), F.col("band_a")).otherwise(F.col("band_b"))
    return pairs.where(_similar_sizes("n_a", "n_b") & (F.col("scheme") == own))


def _at(name: str, side: str):
    """That side's value in the pair's scheme: of its own band or of the one below."""
    return F.when(F.col(f"band_{side}") == F.col("scheme"), F.col(f"{name}0_{side}")).otherwise(F.col(f"{name}1_{side}"))


def _families(met: DataFrame, classes: DataFrame, plan: dict[int, bool]) -> DataFrame:
    """(key, family, h): the families of classes that may be similar, and how many signatures with many classes each has."""
    facts = classes.select("key", "check", "n", "band", "e0", "e1")
    top = F.array(*(F.lit(_EDGES[j + 1] - 1 + 4 * (_EDGES[j + 1] - 1) // 3) for j in range(len(_EDGES) - 1)))
    partner = F.least(F.col("n") + F.floor(F.col("n") * 4 / 3), F.get(top, F.col("scheme").cast("int")))
    empty = F.when(F.col("scheme") == F.col("band"), F.col("e0")).otherwise(F.col("e1"))

    # the signatures with many classes that each class has in a scheme, from the rarest on
    held = met.where("grp is not null").groupBy(F.col("a").alias("key"), "scheme").agg(F.sort_array(F.collect_list(F.struct("n", "grp", "b"))).alias("held"))
    held = held.join(facts, "key").where("scheme in (band, band - 1)").withColumn("h", F.size("held").cast("long")).withColumn("e", empty).withColumn("least", _bound(plan, F.col("scheme"), partner, empty))
    heavy = lambda x: F.when(F.col("h") >= F.col("least"), x)
    first = F.slice("held", F.lit(1), F.greatest(F.col("h") - F.col("least") + 1, F.lit(0)).cast("int"))
    held = held.select("key", "check", "scheme", "band", "n", "e", "h", heavy(F.array_distinct(F.transform(first, lambda x: x["b"]))).alias("labels"), heavy(F.transform("held", lambda x: x["grp"])).alias("grps"))
    held = written(held, "class-signatures")
    of_scheme = lambda below: F.coalesce(F.max(F.when(F.col("scheme") == F.col("band") - below, F.col("h"))), F.lit(0)).alias(f"h{below}")
    info = written(facts.join(held.groupBy("key", "check").agg(of_scheme(0), of_scheme(1)), ["key", "check"], "left").drop("check").na.fill(0, ["h0", "h1"]), "class-info")

    shared = met.where("grp is null").groupBy("a", "b", "scheme").agg(F.sum("n").alias("shared"))
    bound = _bound(plan, F.col("scheme"), F.col("n_a") + F.col("n_b"), F.least(_at("e", "a"), _at("e", "b")))
    pairs = _sides(shared, info).where(F.col("shared") + F.least(_at("h", "a"), _at("h", "b")) >= bound).select("a", "b")
    found = components(pairs.unionByName(_counted(held.where("grps is not null"), plan)))
    return found.select(F.col("node").alias("key"), F.col("component").alias("family")).join(info.groupBy("key").agg(F.max("h0").alias("h")), "key")


def _counted(heavy: DataFrame, plan: dict[int, bool]) -> DataFrame:
    """(a, b): a spanning forest of the pairs of heavy classes that share enough signatures with many classes."""
    near = components(heavy.select(F.col("key").alias("a"), F.explode("labels").alias("b")))
    heavy = written(heavy.join(near.select(F.col("node").alias("key"), F.col("component").alias("near")), "key").select("key", "near", "scheme", "band", "n", "e", "h", "grps"), "heavy-classes")
    sizes = heavy.groupBy("near", "scheme").agg(F.count(F.lit(1)).alias("_n"), F.max("h").alias("_most")).where("_n > 1")
    sizes = sizes.select("near", "scheme", "_n", _blocks(F.col("_n"), F.col("_most")).alias("blocks"))
    dealt = join_groups(heavy, sizes, ["near", "scheme"], "_n", heavy.count()).where("blocks is not null").withColumn("_own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    tile = lambda j: _tile("near", "scheme", F.least("_own", j), F.greatest("_own", j))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(tile(j).alias("tile"), F.when(F.col("_own") <= j, 0).otherwise(1).alias("side")))
    dealt = dealt.select("key", "scheme", "band", "n", "e", "grps", F.inline(tiles)).repartition("tile").sortWithinPartitions("tile")

    def count(batches):
        from pointweave.llm import jaccard

        parts = (np.array([jaccard.segments(j, plan.get(j, False)) for j in range(len(jaccard._EDGES) - 1)]), np.array([2 if plan.get(j, False) else 1 for j in range(len(jaccard._EDGES) - 1)]))

        def done(sides):
            if len(sides[0]) < (1 if sides[1] else 2):
                return None
            shared = jaccard.common(*([np.sort(np.array(r[-1], np.int64)) for r in x] or None for x in sides))
            one, two = (np.array([r[:-1] for r in (x or sides[0])], np.int64).T for x in sides)
            return jaccard._enough(shared, one, two, parts, bool(sides[1]))

        for sides in jaccard._tiles(batches, ("key", "scheme", "band", "n", "e", "grps")):
            if (links := done(sides)) is not None:
                yield links

    return dealt.select("tile", "side", "key", "scheme", "band", "n", "e", "grps").mapInArrow(lean(count), "a long, b long")


def _tiles(batches, columns: tuple[str, ...]):
    """Yields for each tile its rows of side 0 and of side 1; batches are sorted by tile."""
    now, sides = None, ([], [])
    for batch in batches:
        for tile, side, *row in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", *columns))):
            if tile != now:
                if now is not None:
                    yield sides
                now, sides = tile, ([], [])
            sides[side].append(row)
    if now is not None:
        yield sides


def _enough(shared: np.ndarray, one: np.ndarray, two: np.ndarray, parts, across: bool) -> pa.RecordBatch:
    """The forest of the pairs that share enough signatures; one, two: key, scheme, band, n, e of rows and columns."""
    n1, n2 = one[3][:, None], two[3][None, :]
    scheme = one[1][:, None]
    own = np.where(n1 <= n2, one[2][:, None], two[2][None, :])
    bound = np.maximum(1, parts[0][scheme] - (n1 + n2) // 7 // parts[1][scheme] - np.minimum(one[4][:, None], two[4][None, :]))
    x, y = forest((shared >= bound) & (4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)) & (own == scheme), across)
    keys = np.r_[one[0], two[0]] if across else one[0]
    return pa.RecordBatch.from_arrays([pa.array(keys[x]), pa.array(keys[y])], ["a", "b"])


def common(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many elements each set of a has in common with each of b, or of a itself (where the diagonal means nothing);
    sets are sorted arrays of distinct integers."""
    every = a + (b or [])
    k, cut = len(every), len(a)
    owner = np.repeat(np.arange(k), [len(t) for t in every])
    flat = np.concatenate(every)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    times = np.diff(np.r_[first, len(flat)])
    wide = k if b is None else k - cut
    out = np.zeros(cut * wide, np.int64)
    rare = min(k, 12)
    for f in range(2, rare + 1):  # elements of few sets: each pair of owners counts one
        at = first[times == f]
        if len(at):
            xs, ys = np.triu_indices(f, 1)
            x, y = owner[(at[:, None] + xs).ravel()], owner[(at[:, None] + ys).ravel()]
            if b is not None:
                across = (x < cut) & (y >= cut)
                x, y = x[across], y[across] - cut
            out += np.bincount(x * wide + y, minlength=len(out))
    out = out.reshape(cut, wide)
    if b is None:
        out = out + out.T
    many = np.flatnonzero(times > rare)  # elements of many sets: columns of a matrix
    step = max(1, CELLS // k)
    for lo in range(0, len(many), step):
        part = many[lo : lo + step]
        n = times[part]
        at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        x = np.zeros((k, len(part)), np.float32)
        x[owner[at], np.repeat(np.arange(len(part)), n)] = 1
        out = out + (x @ x.T if b is None else x[:cut] @ x[cut:].T).astype(np.int64)
    return out


def similar(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """A matrix of which sets of a are similar to which of b, or of a itself; sets are sorted arrays of shingles."""
    both, na = common(a, b), np.array([len(t) for t in a], np.int64)
    nb = na if b is None else np.array([len(t) for t in b], np.int64)
    return 100 * both >= 75 * (na[:, None] + nb[None, :] - both)


def forest(linked: np.ndarray, across: bool) -> np.ndarray:
    """Pairs (member, least member of its component) that keep the components of a matrix of links, over rows or, with
    across, over rows and then columns."""
    rows, columns = linked.shape
    label = np.arange(rows + columns if across else rows)
    far = len(label)
    while True:
        if across:
            top, side = label[:rows], label[rows:]
            new = np.r_[np.minimum(top, np.where(linked, side[None, :], far).min(1, initial=far)), np.minimum(side, np.where(linked, top[:, None], far).min(0, initial=far))]
        else:
            new = np.minimum(label, np.where(linked, label[None, :], far).min(1, initial=far))
        new = new[new]
        if (new == label).all():
            return np.stack([np.flatnonzero(label != np.arange(len(label))), label[label != np.arange(len(label))]])
        label = new


def _verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): links that keep the components of the similar classes that share a tile.

    members: key, check, node, doc_id (of a document with that set), tiles (array of struct tile, side). Pairs within
    side 0, if a tile has no side 1, or else those between the sides are looked at."""
    spark = session(docs)
    some = written(members.select("key", "check", "node", F.col("doc_id").alias("_of"), "tiles"), "members")
    bitmap, bits = repeated_filter(some.select(F.xxhash64("_of").alias("h")), "h", some.count(), least=1)
    held = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(maybe_repeated(h.to_numpy(zero_copy_only=False), held.value, bits))

    def shingled(batches):
        from pointweave.llm import jaccard

        for b in batches:
            ours, tokens = [], []
            keys, checks = b.column("key").to_pylist(), b.column("check").to_pylist()
            for i, t in jaccard.sets(b.column("text").cast(pa.binary()).to_pylist()):
                if len(t) and jaccard.set_keys(t) == (keys[i], checks[i]):
                    ours.append(i)
                    tokens.append(t.tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(ours, pa.int64())) for c in ("node", "tiles")), pa.array(tokens, pa.binary())], ["node", "tiles", "tokens"])

    def verify(batches):
        from pointweave.llm import jaccard

        for sides in jaccard._tiles(batches, ("node", "tokens")):
            one, two = (sorted({node: np.frombuffer(tokens, _U) for node, tokens in x}.items()) for x in sides)  # rows with one set and one doc_id come once
            if len(one) < (1 if two else 2):
                continue
            linked = jaccard.similar([t for _, t in one], [t for _, t in two] or None)
            x, y = jaccard.forest(linked, bool(two))
            nodes = np.array([n for n, _ in one + two], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], ["a", "b"])

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(maybe(F.xxhash64(F.col("doc_id"))))
    # a class all of whose rows have no doc_id is found by the null
    found = hashed.join(some, F.col("doc_id").eqNullSafe(F.col("_of"))).select("text", "key", "check", "node", "tiles")
    found = found.mapInArrow(lean(shingled), "node long, tiles array<struct<tile:string,side:int>>, tokens binary")
    dealt = found.select("node", "tokens", F.inline("tiles")).repartition("tile").sortWithinPartitions("tile")
    return written(dealt.select("tile", "side", "node", "tokens").mapInArrow(lean(verify), "a long, b long"), "links")


def _blocks(count, largest):
    """How many blocks so many classes of at most so many shingles are dealt into."""
    return F.ceil(count / F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / largest)))).cast("long")


def _tile(*parts):
    return F.concat_ws(":", *(F.col(p) if isinstance(p, str) else p for p in parts))


def _one_tile_each(members: DataFrame) -> DataFrame:
    """The members with the tile of their family's block; hubs of families of several blocks are in all of these."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    own = F.array(block)
    hubs = members.where("blocks > 1").groupBy("family", "band").agg(F.max(F.struct("h", "node"))["node"].alias("_hub")).select("_hub").distinct()
    marked = members.join(hubs, F.col("node") == F.col("_hub"), "left")
    places = F.when(F.col("_hub").isNull(), own).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return marked.withColumn("tiles", F.transform(places, lambda i: F.struct(_tile("family", i).alias("tile"), F.lit(0).alias("side"))))


def _tiles_across(members: DataFrame, comps: DataFrame, total: int) -> DataFrame:
    """The members of families of several blocks that are not one component yet, with the tiles in which every two
    classes of different components (and similar enough sizes) meet.

    A family falls into parts by band, and by whether a class is in the family's largest component. Each part is dealt
    into blocks; two blocks are a tile, but for blocks of the largest component with one another."""
    labelled = members.where("blocks > 1").join(comps.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labelled.groupBy("family", "component").agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.groupBy("family").agg(F.max(F.struct("_n", "component"))["component"].alias("_largest"), F.count(F.lit(1)).alias("_comps"), F.sum("_n").alias("_all"))
    largest = written(largest.where("_comps > 1"), "open-families")
    labelled = join_groups(labelled, largest, ["family"], "_all", total).where("_largest is not null")
    labelled = labelled.withColumn("part", F.col("band") * 2 + (F.col("component") == F.col("_largest")).cast("long"))
    parts = written(labelled.groupBy("family", "part").agg(F.count(F.lit(1)).alias("_n"), F.max("n").alias("_most")).select("family", "part", _blocks(F.col("_n"), F.col("_most")).alias("_blocks")), "family-parts")
    one, other = parts.toDF("family", "part", "_own"), parts.toDF("family", "_with", "_others")
    near = F.abs(F.floor(F.col("part") / 2) - F.floor(F.col("_with") / 2)) <= 1
    meet = one.join(other, "family").where(near & ~((F.col("part") % 2 == 1) & (F.col("_with") % 2 == 1)))
    meet = meet.groupBy("family", "part").agg(F.first("_own").alias("_own"), F.collect_list(F.struct("_with", "_others")).alias("_meets"))
    placed = labelled.join(meet, ["family", "part"]).withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_own")))

    def tiles(m):
        def at(j):
            mine, theirs = _tile("part", "_block"), F.concat_ws(":", m["_with"], j)
            before = (F.col("part") < m["_with"]) | (F.col("part") == m["_with"]) & (F.col("_block") <= j)
            pair = F.when(before, F.concat_ws("/", mine, theirs)).otherwise(F.concat_ws("/", theirs, mine))
            return F.struct(F.concat_ws("=", F.col("family"), pair).alias("tile"), F.when(before, 0).otherwise(1).alias("side"))

        return F.transform(F.sequence(F.lit(0).cast("long"), m["_others"] - 1), at)

    return placed.withColumn("tiles", F.flatten(F.transform("_meets", tiles)))


def _members(classes: DataFrame, families: DataFrame, total: int) -> DataFrame:
    """key, check, node, doc_id, family, n, band, h, and blocks: how many blocks the family has."""
    of = classes.join(families, "key").select("key", "check", "node", F.col("first").alias("doc_id"), "family", "n", "band", "h")
    of = written(of, "family-members")
    sizes = of.groupBy("family").agg(F.count(F.lit(1)).alias("_n"), F.max("n").alias("_most"))
    sizes = sizes.select("family", "_n", _blocks(F.col("_n"), F.col("_most")).alias("blocks"))
    return written(join_groups(of, sizes.where("_n > 1"), ["family"], "_n", total).where("blocks is not null"), "family-members")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    return _linked(docs).select("doc_id", "n_shingles", "component_id")


def _classes(some: DataFrame) -> DataFrame:
    """One row for each set. node is its number in links: the key, or the check where several sets have one key."""
    least = [F.min(c).alias(c) for c in ("n", "band", "e0", "e1")]
    classes = written(some.groupBy("key", "check").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"), *least), "classes")
    twins = written(classes.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key", F.lit(True).alias("_twin")), "key-twins")
    if twins.isEmpty():
        return classes.withColumn("node", F.col("key"))
    classes = written(classes.join(twins, "key", "left").withColumn("node", F.when(F.col("_twin"), F.col("check")).otherwise(F.col("key"))).drop("_twin"), "classes")
    if not classes.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        raise RuntimeError("different sets have one key and one check: change the constants of set_keys")
    return classes


def _linked(docs: DataFrame) -> DataFrame:
    """link's columns, the key and check of each row's set, and whether it is the set that stays of its component: of
    those with the smallest doc_id (null only if all are) the least. Rows without shingles have no key."""
    spark = session(docs)
    ship(spark)
    rows = docs.count()
    plan = allocate(_sampled_sets(docs, rows), rows)
    slim = written(_slim(docs, plan), "shingle-sets")
    n = slim.agg(F.sum("n")).first()[0] or 0
    some = slim.where("n > 0")
    classes = _classes(some)
    buckets = 64
    while buckets * BUCKET_ROWS < n and buckets < 1 << 16:
        buckets *= 2
    parts = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = written(_met(_signed(docs, plan, buckets), parts), "met")
    total = max(rows, 1)
    members = _members(classes, _families(met, classes, plan), total)
    links = _verified(docs, _one_tile_each(members))
    comps = components(links)
    if not members.where("blocks > 1").isEmpty():
        apart = _tiles_across(members, comps, total)
        more = _verified(docs, apart)
        if not more.isEmpty():
            comps = components(links.unionByName(more))

    comps = comps.select("node", "component")
    of = classes.join(comps, "node", "left").select("key", "check", "first", "size", F.coalesce("component", "node").alias("component"))
    heads = of.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("_none"), "first", "key", "check")).alias("_head"), F.count(F.lit(1)).alias("_members"))
    heads = heads.select("component", F.col("_head.first").alias("component_id"), F.col("_head.key").alias("_hk"), F.col("_head.check").alias("_hc"), "_members")
    stays = (F.col("key") == F.col("_hk")) & (F.col("check") == F.col("_hc"))
    resolved = join_groups(of.select("key", "check", "size", "component"), heads, ["component"], "_members", total).select("key", "check", "size", "component_id", stays.alias("head"))
    joined = join_groups(some.select("doc_id", "n", "key", "check"), resolved, ["key", "check"], "size", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "key", "check", "head")
    none = F.lit(None).cast("long")
    return joined.unionByName(slim.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("key"), none.alias("check"), F.lit(True).alias("head")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of every component, with the smallest doc_id, and all without shingles. All
    columns are kept, whatever their names.

    Rows whose doc_id a Bloom filter of the doubtful ones lacks pass straight through; the others are settled by doc_id
    and set, so that rows with one doc_id (null or repeated) and different texts don't share a fate. Of rows equal in
    both one stays, any one."""
    spark = session(docs)
    found = written(_linked(docs), "components")
    stays = F.col("key").isNull() | F.col("head") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    marked = found.select("doc_id", "key", "check", stays.alias("stays"))
    # of a doc_id: all its rows, and those that stay for certain as they are
    ids = marked.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows"), F.count(F.when(F.col("stays"), 1)).alias("_kept"), F.count(F.when(F.col("stays"), F.col("key"))).alias("_keyed"))
    doubtful = written(ids.where((F.col("_kept") < F.col("_rows")) | (F.col("_keyed") > 1)).select("_id", (F.col("_kept") > 0).alias("_some")), "doubtful-ids")
    bitmap, bits = repeated_filter(doubtful.select(F.xxhash64("_id").alias("h")), "h", doubtful.count(), least=1)
    held = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(maybe_repeated(h.to_numpy(zero_copy_only=False), held.value, bits))

    wrapped = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("own"), F.col("text").alias("said"))
    tested = wrapped.withColumn("maybe", maybe(F.xxhash64("own")))
    of_id = F.col("own").eqNullSafe(F.col("_id"))
    out = tested.where(~F.col("maybe")).select("row").unionByName(tested.where("maybe").join(doubtful, of_id, "left_anti").select("row"))
    some = doubtful.where("_some").select("_id")
    if some.isEmpty():
        return out.select("row.*")

    @F.arrow_udf("string")
    def set_name(text: pa.Array) -> pa.Array:
        from pointweave.llm import jaccard

        names = [None] * len(text)
        for i, t in jaccard.sets(text.cast(pa.binary()).to_pylist()):
            if len(t):
                names[i] = "{}:{}".format(*jaccard.set_keys(t))
        return pa.array(names, pa.string())

    kept = marked.where("stays and key is not null").join(some, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    kept = kept.select(F.col("doc_id").alias("_id"), F.concat_ws(":", "key", "check").alias("_set")).distinct()
    mixed = tested.where("maybe").join(some, of_id, "left_semi").withColumn("set", set_name("said"))
    blank = mixed.where("set is null")
    full = mixed.where("set is not null").join(kept, of_id & (F.col("set") == F.col("_set")), "left_semi").dropDuplicates(["own", "set"])
    return out.unionByName(blank.select("row")).unionByName(full.select("row")).select("row.*")
