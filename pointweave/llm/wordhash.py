"""64-bit hashes of the words of many texts at once, in numpy over UTF-8 bytes.

A word is a run of bytes other than space and \\x09-\\x0D; A-Z count as a-z. Its hash is a polynomial over per-byte random
numbers, read off a running sum at the word's two ends, then mixed. Blocks are bounded, and a text longer than a block is
cut at white space, so memory follows the block and the words of one text.
"""

from __future__ import annotations

import numpy as np

from pointweave.llm.bloom import mix

BLOCK = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
UPPER, LOWER, DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = True
END = np.arange(256, dtype=np.uint8)
END[UPPER | LOWER] = 0
END[DIGIT] = 48
END[128:] = 0
_tables: list = []


def _powers(base: int, n: int) -> np.ndarray:
    p = np.ones(n, _U)
    at, step = 1, base
    while at < n:
        p[at : 2 * at] = p[: min(at, n - at)] * _U(step)
        at, step = 2 * at, step * step & (2**64 - 1)
    return p


def _table(n: int):
    if not _tables or len(_tables[1]) < n:
        size = max(n, BLOCK + 4096)
        byte = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
        byte[65:91] = byte[97:123]
        _tables[:] = [byte, _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)]
    return _tables


def block_hashes(buf: np.ndarray, shapes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hash, start, shape) of every word in a buffer of bytes.

    The shape of a word says whether it has digits, whether all its ASCII letters are upper case, and which characters
    that are no letters it ends with, two at most."""
    byte, up, down = _table(len(buf) + 1)
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    c = np.zeros(len(buf) + 1, _U)
    np.cumsum(byte[buf] * up[: len(buf)], out=c[1:])
    hashed = mix((c[end] - c[start]) * down[start] + (end - start).astype(_U))
    if not shapes:
        return hashed, start, None
    count = lambda kind: (n := np.r_[0, np.cumsum(kind[buf], dtype=np.int32)])[end] - n[start]
    upper, lower, digit = count(UPPER), count(LOWER), count(DIGIT)
    last, before = END[buf[end - 1]], np.where(end - start > 1, END[buf[np.maximum(end - 2, start)]], 0)
    shape = (upper > 1) & (lower == 0)
    return hashed, start, last.astype(_U) | (before.astype(_U) << _U(8)) | (shape.astype(_U) << _U(16)) | ((digit > 0).astype(_U) << _U(17))


def _long(text: bytes, shapes: bool) -> tuple[np.ndarray, np.ndarray | None]:
    out, shape, at, buf = [], [], 0, np.frombuffer(text, np.uint8)
    while at < len(buf):
        end = min(len(buf), at + BLOCK)
        if end < len(buf):
            gaps = np.flatnonzero(SPACE[buf[at:end]])
            while not len(gaps) and end < len(buf):
                end = min(len(buf), end + BLOCK)
                gaps = np.flatnonzero(SPACE[buf[at:end]])
            if end < len(buf):
                end = at + int(gaps[-1]) + 1
        w, _, s = block_hashes(buf[at:end], shapes)
        out.append(w)
        shape.append(s)
        at = end
    return np.concatenate(out), np.concatenate(shape) if shapes else None


def word_hashes(texts: list[bytes | None], shapes: bool = False):
    """Yields (first, words, shapes, offsets): texts first .. first + len(offsets) - 2 have words[offsets[i]:offsets[i + 1]]."""
    i = 0
    while i < len(texts):
        size, j = 0, i
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= BLOCK):
            size += len(texts[j] or b"") + 1
            j += 1
        if j == i + 1 and size > BLOCK:
            w, s = _long(texts[i], shapes)
            yield i, w, s, np.array([0, len(w)])
        else:
            block = [t or b"" for t in texts[i:j]]
            ends = np.cumsum([len(t) + 1 for t in block])
            w, start, s = block_hashes(np.frombuffer(b"\n".join(block) + b"\n", np.uint8), shapes)
            yield i, w, s, np.r_[0, np.searchsorted(start, ends)]
        i = j
