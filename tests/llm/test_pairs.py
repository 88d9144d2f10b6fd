"""The operators on equal and similar texts, against brute force."""

import random

import pytest

from pointweave.llm import exact_dedup, jaccard

SCHEMA = "doc_id bigint, text string, source string, maybe int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "s", 1) for i, t in enumerate(texts)], SCHEMA)


def shingle_set(text):
    table = {i: i + 32 for i in range(65, 91)}
    words = [w for w in (text or "").translate(table).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(sets))}


def corpus(seed, copies, words, change):
    """A base text and copies of it with some words changed, unrelated texts that share a passage, and short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(words)]
    out = []
    for _ in range(copies):
        t = list(base)
        for _ in range(rng.randint(0, change)):
            t[rng.randrange(len(t))] = word()
        out.append(" ".join(t))
    passage = " ".join(word() for _ in range(40))
    out += [f"{' '.join(word() for _ in range(rng.randint(20, 60)))} {passage} {' '.join(word() for _ in range(rng.randint(20, 60)))}" for _ in range(25)]
    out += ["", None, " \n ", "a b c", "A B C", "a b c d", "one two three four five", "One two three  four five", "x"] + [" ".join(base)] * 2
    return out


@pytest.mark.parametrize(("seed", "copies", "words", "change"), [(1, 60, 120, 9), (2, 40, 30, 2), (3, 30, 400, 40), (4, 50, 12, 1)])
def test_jaccard_components(spark, seed, copies, words, change):
    texts = corpus(seed, copies, words, change)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs(spark, texts)).collect()}
    assert got == brute(texts)


def test_jaccard_threshold_is_exact(spark):
    """Sets of 3 and 4 shingles with 3 in common are linked; of 7 with 6 of 8 in common too, with 5 of 9 not."""
    w = [f"w{i}" for i in range(40)]
    texts = [" ".join(w[:7]), " ".join(w[:8]), " ".join(w[10:21]), " ".join(w[11:22]), " ".join(w[25:32]), " ".join(w[27:34])]
    got = {r.doc_id: r.component_id for r in jaccard.link(docs(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in brute(texts).items()}
    assert got[1] == 0 and got[3] == 2 and got[5] == 5


def test_jaccard_deduplicate_keeps_columns(spark):
    texts = corpus(5, 12, 60, 2)
    want = {i for i, (_, c) in brute(texts).items() if i == c}
    out = jaccard.deduplicate(docs(spark, texts))
    assert out.columns == ["doc_id", "text", "source", "maybe"]
    assert {r.doc_id for r in out.collect()} == want


def test_signatures_meet_for_all_similar_sets():
    """Random sets at the edge of the threshold share at least as many signatures as the bound says, under both allocations."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in [3, 4, 7, 12, 20, 33, 60, 150, 400]:
        for _ in range(30):
            d = rng.integers(0, (2 * n) // 7 + 1)
            base = rng.integers(0, 2**63, n + d, dtype=np.uint64)
            gone = rng.integers(0, d + 1)
            a, b = np.unique(base[: n + d - gone]), np.unique(base[d - gone :])
            common = len(np.intersect1d(a, b))
            if len(a) < 3 or len(b) < 3 or 100 * common < 75 * (len(a) + len(b) - common):
                continue
            j = jaccard.band(min(len(a), len(b)))
            assert j in jaccard.schemes(len(a)) and j in jaccard.schemes(len(b))
            for deletion in (False, True):
                x, y = jaccard.signatures(a, j, deletion), jaccard.signatures(b, j, deletion)
                h = (len(a) + len(b)) // 7 // (2 if deletion else 1)
                bound = jaccard.segments(j, deletion) - h - min(jaccard.empty_parts(a, j, deletion), jaccard.empty_parts(b, j, deletion))
                assert len(np.intersect1d(x, y)) >= max(1, bound)


def test_exact_dedup(spark):
    texts = ["a", "b", "a", None, "", "c" * 200_000, "A", "a"]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.annotate(docs(spark, texts)).collect()}
    assert got == {0: (7, 3, False), 1: (1, 1, True), 2: (7, 3, False), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), 6: (6, 1, True), 7: (7, 3, True)}
    out = exact_dedup.deduplicate(docs(spark, texts))
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 5, 6, 7] and out.columns == ["doc_id", "text", "source", "maybe"]


def test_exact_dedup_with_a_full_filter(spark):
    """A filter far too small lets unique rows shuffle, and changes nothing."""
    texts = [f"t{i % 700}" for i in range(1000)]
    rows = exact_dedup.annotate(docs(spark, texts), max_bits=1 << 18).collect()
    assert sum(r.kept for r in rows) == 700 and {r.group_size for r in rows} == {1, 2}


def test_repeated_rows_and_null_ids(spark):
    d = docs(spark, ["x", "x", "y"], [3, 3, None])
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in exact_dedup.annotate(d).collect()) == [("3", 2, True), ("3", 2, True), ("None", 1, True)]
    assert exact_dedup.deduplicate(d).count() == 2


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.annotate(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0
    assert jaccard.link(none).count() == 0 and jaccard.deduplicate(none).count() == 0
