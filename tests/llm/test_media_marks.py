"""The manifest of op7_media, marked with which documents share chunks."""

import random

from pointweave.llm import media


def test_marks_are_joined_once(spark):
    """Every look at the manifest reads marked rows; it joins nothing again. Null and repeated doc_ids keep their marks."""
    rng = random.Random(1)
    word = lambda: " ".join(str(rng.random()) for _ in range(900))
    twice = word()
    texts = [(1, twice), (2, twice), (2, word()), (None, twice), (None, word()), (3, word()), (4, None), (5, "")]
    manifest, own, pool = media.store(spark.createDataFrame(texts, "doc_id long, text string"))
    assert "Join" not in manifest._jdf.queryExecution().optimizedPlan().toString()
    marks = sorted((r.doc_id or 0, r.n_bytes, r.shared) for r in manifest.collect())
    shares = lambda t: t in (twice, None, "")
    assert marks == sorted((i or 0, len(t or ""), shares(t)) for i, t in texts)
    assert media.read(manifest, own, pool).count() == len(texts)
