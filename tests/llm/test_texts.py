"""The operators on single texts: edge cases, exact round trips, held-out accuracy on a small made-up corpus."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pointweave.llm import bpe, html, langid, media, mixing, quality, tokens, warc
from pointweave.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path

TEXTS = [None, "", " ", "a", "I'm sure they'll  see\n\n it's 12 o'clock", "<|endoftext|> x<|endoftext|>", "日本語 🎉 ñandú", "𐥀 unassigned 12", "a" * 3000, "word " * 300_000, "ÀÉ ß Ķ &<| yŸ"]
SCHEMA = "doc_id bigint, text string, lang string, source string, score string, kept int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, 1) for i, t in enumerate(texts)], SCHEMA)


def test_bpe_is_the_librarys(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    for r in bpe.digests(docs(spark, TEXTS), tokenizer_path(BYTE_BPE)).collect():
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    again = bpe.decode(bpe.encode(docs(spark, TEXTS), tokenizer_path(BYTE_BPE)), tokenizer_path(BYTE_BPE), column="back").collect()
    assert all(r.back == (r.text or "") for r in again)


def test_bpe_random_pieces():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer_path(BYTE_BPE)), bpe.codec(open(tokenizer_path(BYTE_BPE)).read())
    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("abehtnr  'é1\n") for _ in range(rng.randrange(60)))
        assert np.frombuffer(own.encode(s), "<u4").tolist() == lib.encode(s, add_special_tokens=False).ids


def test_token_files(spark):
    from tokenizers import Tokenizer

    lib, start = Tokenizer.from_file(tokenizer_path(WORD_BPE)), 0
    made = tokens.write(docs(spark, TEXTS), tokenizer_path(WORD_BPE), 2)
    rows = {r.doc_id: r for r in tokens.read(spark, made).collect()}
    for i, t in enumerate(TEXTS):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    name = made.files[0][0]
    assert tokens.File(made.uri, name, made.dictionary).find(3).tolist() == [*lib.encode("a", add_special_tokens=False).ids, 2]
    with pytest.raises(ValueError, match="dictionary"):
        tokens.File(made.uri, name, b"other")


def test_language_id(spark):
    rng = random.Random(2)
    parts = {"x": ["an", "the", "sh", "ing"], "y": ["eau", "é", "ou", "aux"]}
    line = lambda k: " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(30))
    rows = [(i, line(k), k, None, None, 1) for i, k in enumerate("xy" * 100)] + [(900, None, "x", None, None, 1), (901, "12 !!", None, None, None, 1), (902, "", "y", None, None, 1), (903, line("y") * 3000, None, None, None, 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.predict(d).collect()}
    assert all(got[i].lang_pred == k for i, _, k, *_ in rows[:200])
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "y"] and got[900].score == 0
    assert {i for i in got if got[i].held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    model = langid.train(d)
    kept = langid.accepted(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {*range(200), 903}
    assert {r.lang_pred for r in langid.identify(d, langid.Model([], np.zeros((0, 1)), np.zeros(0)), ["doc_id"]).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = lambda: " ".join(word() for _ in range(40)) + "."
    bad = lambda: " ".join([word()] * 20 + [word() + "$$$" for _ in range(20)])
    rows = [(i, (good if i % 2 else bad)(), None, None, None, 1) for i in range(300)] + [(900, None, None, None, None, 1), (901, "", None, None, None, 1)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.predict(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert len(held) > 50 and sum(got[i].predicted == i % 2 for i in held) >= 0.98 * len(held)
    assert got[900].score == got[901].score
    none = quality.predict(spark.createDataFrame(rows[:3], SCHEMA), labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p>unfinished <b", ""), ("<script>var a = '</p>';</script><style>p{}</style>", ""),
        ("<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>Title  &amp; more</h1><p>One&nbsp;two <b>three</b> four.<p>Five.</article><footer>&copy; 2024 someone, all rights</footer>", "Title & more\nOne two three four.\nFive."),
        ("<div class='sidebar'><p>" + "word " * 60 + "</p></div><div id=content><p>Kept text.</p></div><div class=comments><p>" + "post " * 60 + "</p></div>", "Kept text."),
        ("<article><p>A &#x41;&lt;b&gt; &copy</p><form><p>Sign up here please</p></form><!-- <p>no</p> --><p>End</p></article>", "A A<b> ©\nEnd"),
    ],
)
def test_main_text(page, want):
    assert html.extract(page) == want


def test_main_text_query(spark):
    pages = spark.createDataFrame([(1, "u", None, "z"), (None, None, "<article>x</article>", "z")], "page_id bigint, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html.main_text(pages).collect()) == [("1", "", 0), ("None", "x", 1)]


def test_media(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abc é") for _ in range(60_000))
    texts = [*TEXTS, long, long, long[:30_000] + "x" + long[30_000:], long[20_000:]]
    rows = {r.doc_id: r for r in media.round_trip(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n, p = media.payload_of(t)
        r, m = rows[i], media.header(len(p)) + p
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256, r.media_bytes) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(m).hexdigest(), len(m))
    assert rows[0].feature == rows[1].feature
    _, _, pool = media.store(docs(spark, texts))
    stored = [r.digest for r in pool.collect()]
    assert len(stored) == len(set(stored)) > 5


def test_chunks_follow_content():
    data = np.random.default_rng(1).integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    a, b = media.chunks(data), media.chunks(b"shifted" + data)
    assert b"".join(a) == data and all(len(x) <= media.MOST for x in a)
    assert len({*map(media.digest, a)} & {*map(media.digest, b)}) > 0.8 * len(a)


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://www.Example.com:80/b?q#f", big), (2, "http://a.org/", "small"), (3, "http://a.org/", big), (4, None, None), (9, "http://a.org/", "small"), (5, "http://a.org/", big), (None, "x", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    made = warc.write(warc.pages_as_captures(pages))
    got = {r.page_id: r for r in warc.read(spark, made, warc.merged(spark, made, 3)).collect()}
    assert {i: (got[i].record_type, got[i].refers_to) for i in got} == {1: ("revisit", 5), 2: ("response", None), 3: ("revisit", 5), 4: ("response", None), 9: ("response", None), 5: ("response", None), None: ("response", None)}
    assert got[1].payload_bytes == 1200 and got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    order = sorted(got.values(), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(7)) and [r.url_key for r in order] == sorted(r.url_key for r in order)
    assert got[1].url_key == "com,example,www)/b?q"


def test_loser_tree_merges_any_runs():
    rng = random.Random(6)
    for k in [1, 2, 3, 7, 16]:
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree([iter([(x, x) for x in r]) for r in runs])) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


def test_many_runs_are_merged_in_groups(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 2)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i % 3}", "t") for i in range(40)], "page_id bigint, url string, html string").repartition(5)
    made = warc.write(warc.pages_as_captures(pages))
    rows = warc.merged(spark, made, 4).orderBy("position").collect()
    keys = [(r.url_key, r.date, int(r.capture)) for r in rows]
    assert len(keys) == 40 and keys == sorted(keys)


def test_mixing(spark):
    rows = [(i, "t", None, "big" if i % 10 else ("a" if i % 20 else None), None, 1) for i in range(4000)] + [(0, "t", None, None, None, 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([("big", 1.0), ("a", 1.0), (None, 2.0), ("gone", 5.0)], "source string, weight double")
    out = mixing.mix(d, weights, epochs=2.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    total = sum(n.values())
    assert abs(total - 8000) < 500 and abs(n[None] / total - 0.5) < 0.04 and abs(n["big"] / total - 0.25) < 0.03
    assert out.columns == [*d.columns, "_copy", "_shuffle_key"] and out.exceptAll(mixing.mix(d.repartition(3), weights, epochs=2.0)).isEmpty()
    assert mixing.mix(d, weights.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0


def test_empty_tables(spark):
    none = docs(spark, [])
    assert langid.predict(none).count() == 0
    assert quality.predict(none, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0
    assert bpe.digests(none, tokenizer_path(BYTE_BPE)).count() == 0
    assert tokens.read(spark, tokens.write(none, tokenizer_path(WORD_BPE), 2)).count() == 0
    assert media.round_trip(none).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    made = warc.write(warc.pages_as_captures(pages))
    assert warc.read(spark, made, warc.merged(spark, made)).count() == 0 and html.main_text(pages).count() == 0
