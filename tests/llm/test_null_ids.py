"""Near deduplication of rows whose doc_id is null or repeated."""

from pointweave.llm import jaccard

SCHEMA = "doc_id bigint, text string, source string"

A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
B, C = f"{A} more", f"{A} more still"
X, Y = (" ".join(f"{k}{i}" for i in range(12)) for k in "xy")


Z = " ".join(f"z{i}" for i in range(12))


def test_null_and_repeated_ids(spark):
    """Rows without an id, and rows of one id, stay or go by their own text."""
    rows = [(1, A), (None, B), (None, X), (None, Y), (None, f"{Y} more"), (None, ""), (None, None), (2, C), (2, Z), (3, "a b c"), (3, "a b c")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA)
    out = jaccard.deduplicate(docs)
    got = [(r.doc_id, r.text) for r in out.collect()]
    y = [g for g in got if g[1] in (Y, f"{Y} more")]
    assert out.columns == ["doc_id", "text", "source"] and len(y) == 1
    assert sorted((g for g in got if g not in y), key=str) == sorted([(1, A), (None, X), (None, ""), (None, None), (2, Z), (3, "a b c")], key=str)
