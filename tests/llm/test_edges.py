"""Clashing column names, ids of every kind, repeated rows and ties."""

import hashlib
import random

import numpy as np

from pointweave.llm import exact_dedup, jaccard, langid, media, mixing, quality, tokens, warc
from pointweave.llm.queries import WORD_BPE, tokenizer_path

#: Names that operators use, or once used, for columns of their own.
NAMES = ["_count", "_copy", "_shuffle_key", "_src", "copy", "row", "own", "said", "maybe", "_maybe", "_sha", "_keep", "set", "id", "from", "h", "a.b", "key", "lang_pred", "_text"]


def clashing(spark, texts):
    columns = ", ".join(f"`{n}` int" for n in NAMES)
    rows = [(i, t, "en", f"s{i % 2}", *(100 * i + k for k in range(len(NAMES)))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, {columns}")


def test_columns_of_any_name_are_carried(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = clashing(spark, [long, long, f"{long} more", "another text of a few words that is like no other one", None, ""])
    whole = {tuple(r) for r in docs.collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "__copy", "__shuffle_key"]
    assert {tuple(r)[: len(docs.columns)] for r in mixed.collect()} <= whole
    for out, want in ((exact_dedup.deduplicate(docs), {1, 2, 3, 5}), (jaccard.deduplicate(docs), {0, 3, 4, 5}), (langid.accepted(docs, langid.train(docs)), {0, 1, 2, 3})):
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r.doc_id for r in rows} == want and {tuple(r) for r in rows} <= whole


def test_mixing_is_the_brute_force_inversion(spark):
    """Counts by the definition, in Python's own arithmetic."""
    import math

    rows = [(i, "t", "en", "big" if i % 5 else "small") for i in range(400)] + [(None, "t", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    sizes = {s: sum(r[3] == s for r in rows) for s in ("big", "small", None)}
    want = {}
    for i, _, _, s in rows:
        rate = len(rows) / len(sizes) / sizes[s]
        pieces = max(1, math.ceil(rate / mixing.PIECE))
        n = 0
        for k in range(1, pieces + 1):
            u = int(hashlib.md5(f"mix:{'' if i is None else i}:{k}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / pieces)
            while c <= u and p > 1e-18:
                n += 1
                p *= rate / pieces / n if pieces == 1 else 0
                c += p
            if pieces > 1:  # of the sum of pieces only its mean is looked at
                n = None
                break
        want[i] = n
    got = {}
    for r in mixing.mix(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert all(got.get(i, 0) == n for i, n in want.items() if n is not None) and abs(got[None] - 401 / 3) < 60


def test_many_sources_join_by_salt(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "t", "en", f"s{i % 7}") for i in range(200)], "doc_id bigint, text string, lang string, source string")
    want = sorted(tuple(r) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 3)
    assert sorted(tuple(r) for r in mixing.mix(docs).collect()) == want


def test_warc_takes_any_whole_number(spark):
    ids = [2**62, -(2**62), -5, 0, 3 * 10**11, 2**62 + 1, 7]
    pages = spark.createDataFrame([(i, "http://a.org/", "t") for i in ids], "page_id bigint, url string, html string")
    made = warc.write(warc.pages_as_captures(pages))
    got = sorted(warc.read(spark, made, warc.merged(spark, made, 2)).collect(), key=lambda r: r.position)
    assert [r.page_id for r in got] == sorted(ids)


def test_null_and_repeated_ids(spark):
    texts = [(None, "one"), (None, "two"), (5, "x" * 70_000), (5, "x" * 70_000), (5, "y"), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = [(r.doc_id, r.payload_sha256) for r in media.round_trip(docs).collect()]
    assert sorted(rows, key=str) == sorted(((i, hashlib.sha256(media.payload_of(t)[1]).hexdigest()) for i, t in texts), key=str)
    read = tokens.read(spark, tokens.write(docs, tokenizer_path(WORD_BPE), 2)).collect()
    assert sorted(str(r.doc_id) for r in read) == sorted(str(i) for i, _ in texts)
    order = sorted(read, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None] * 3 + [5] * 3 and [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1]]


def test_quality_of_text_ids_and_repeated_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(f"d{i}", " ".join(word() for _ in range(40)) + "." if i % 2 else " ".join([word()] * 30)) for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, rows[0][1])], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(200)], "doc_id string, quality int")
    got = quality.predict(docs, labels).collect()
    assert len(got) == 204 and sum(r.predicted == int(r.doc_id[1:]) % 2 for r in got if r.doc_id) >= 0.97 * 203
    first = [r.score for r in got if r.doc_id in ("d0", None)]
    assert len(first) == 3 and len(set(first)) == 1


def test_language_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([(i, "abc abd", "yx"[i % 2]) for i in range(8)], "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, model, ["doc_id"]).collect()} == {("x", 0.5)}


def test_language_scores_are_brute_force(spark):
    """Counts, smoothing and posterior by dictionaries over the buckets of every n-gram."""
    import math

    rng = random.Random(9)
    docs = [(i, " ".join("".join(rng.choice("abcde" if i % 3 else "cdefg") for _ in range(rng.randint(1, 6))) for _ in range(12)), f"l{i % 3 > 0}") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")

    def grams(text):
        out = []
        for codes, _, starts in langid.windows([text]):
            for at in langid.grams(codes, starts):
                out += [int(x) for x in at if x >= 0]
        return out

    langs = sorted({x for _, _, x in docs})
    counts = {x: {} for x in langs}
    for _, t, x in docs:
        for g in grams(t):
            counts[x][g] = counts[x].get(g, 0) + 1
    logs = {}
    for _, t, _ in docs[:20]:
        z = []
        for x in langs:
            total = sum(counts[x].values()) + langid.ALPHA * langid.BUCKETS
            z.append(math.log(sum(y == x for _, _, y in docs) / len(docs)) + sum(math.log((counts[x].get(g, 0) + langid.ALPHA) / total) for g in grams(t)))
        logs[t] = (langs[z.index(max(z))], 1 / sum(math.exp(v - max(z)) for v in z))
    got = {r.doc_id: r for r in langid.identify(frame, langid.train(frame), ["doc_id"]).collect()}
    for i, t, _ in docs[:20]:
        assert got[i].lang_pred == logs[t][0] and abs(got[i].score - logs[t][1]) < 1e-4
