"""Bloom filter of the hashes that occur more than once, built in one pass over 64-bit hashes.

Each task turns its rows into a partial filter in sparse form (sorted bit positions for each segment of the filter, and
those that it has met twice itself). Partial filters move by segment and are merged as they stream in, two bits for
each position: met, met again. Only the second plane is kept. Its size is bounded by max_bits, whatever the input; with
more rows than it is made for, more unique hashes pass as possibly repeated, and none of the repeated ones is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointweave.llm.common import lean, session, ship

#: Bits of the filter for each row, and the most bits it may have (32 MB).
BITS_A_ROW, MAX_BITS = 16, 1 << 28
SEGMENT = 1 << 18
PROBES = 2


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    bits = SEGMENT
    while bits < rows * BITS_A_ROW and bits < max_bits:
        bits *= 2
    return bits


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    h = hashes.view(np.uint64)
    return [mix(h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))) & np.uint64(bits - 1) for k in range(PROBES)]


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> np.uint32(3), np.left_shift(np.uint8(1), (at & np.uint32(7)).astype(np.uint8)))


def _get(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def repeated_filter(df: DataFrame, column: str, rows: int, max_bits: int = MAX_BITS, least: int = 2) -> tuple[np.ndarray, int]:
    """(bitmap, bits): a filter that holds every non-null value of the long column which df has more than once (or at all, for least 1)."""
    spark = session(df)
    ship(spark)
    bits = filter_bits(rows, max_bits)

    def partial(batches):
        once: list[np.ndarray] = []

        def flush():
            p, n = np.unique(np.concatenate(once), return_counts=True)
            segment = (p // np.uint64(SEGMENT)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            at = (p % np.uint64(SEGMENT)).astype(np.uint32)
            ends = np.r_[cuts[1:], len(p)]
            once.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(segment[cuts]),
                    pa.array([at[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                    pa.array([at[a:b][n[a:b] > 1].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                ],
                ["segment", "met", "again"],
            )

        held = 0
        for b in batches:
            h = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(h):
                # one hash counts once for each position it has, so both probes on one bit don't look like a repeat
                p = np.stack(positions(h, bits))
                p = np.where(p[1] == p[0], np.stack([p[0], (p[0] + np.uint64(1)) & np.uint64(bits - 1)]), p)
                once.append(p.ravel())
                held += p.size
            if held > 2_000_000:
                yield flush()
                held = 0
        if once:
            yield flush()

    def merge(batches):
        met: dict[int, np.ndarray] = {}
        again: dict[int, np.ndarray] = {}
        for b in batches:
            for s, m, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = np.frombuffer(m, np.uint32)
                seen = met.setdefault(s, np.zeros(SEGMENT // 8, np.uint8))
                twice = again.setdefault(s, np.zeros(SEGMENT // 8, np.uint8))
                old = (seen[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & 1 == 1
                _set(twice, at[old])
                _set(twice, np.frombuffer(a, np.uint32))
                _set(seen, at)
        for s, plane in (again if least > 1 else met).items():
            if plane.any():
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([plane.tobytes()], pa.binary())], ["segment", "plane"])

    segments = bits // SEGMENT
    parts = max(1, min(segments, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = (
        df.select(column)
        .mapInArrow(lean(partial), "segment long, met binary, again binary")
        .repartition(parts, "segment")
        .mapInArrow(lean(merge), "segment long, plane binary")
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.collect():  # at most max_bits, whatever the input
        out[r.segment * (SEGMENT // 8) : (r.segment + 1) * (SEGMENT // 8)] = np.frombuffer(r.plane, np.uint8)
    return out, bits


def maybe_repeated(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """For each hash whether it may be in the filter; a false is certain."""
    p = positions(hashes, bits)
    p[1] = np.where(p[1] == p[0], (p[0] + np.uint64(1)) & np.uint64(bits - 1), p[1])
    return _get(bitmap, p[0]) & _get(bitmap, p[1])
