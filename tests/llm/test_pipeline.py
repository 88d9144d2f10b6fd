"""The pipeline against brute force over small documents."""

import hashlib
import importlib.util
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

from pointweave.llm import mixing
from pointweave.llm.queries import BYTE_BPE, tokenizer_path

spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).resolve().parents[2] / "corpus_pipeline.py")
corpus_pipeline = importlib.util.module_from_spec(spec)
spec.loader.exec_module(corpus_pipeline)


def copies(left):
    """How often each of the documents left (doc_id, source) comes, by the definition, in Python's own arithmetic."""
    sizes = {}
    for _, s in left:
        sizes[s] = sizes.get(s, 0) + 1
    out = {}
    for i, s in left:
        rate = len(left) / len(sizes) / sizes[s]
        assert rate <= mixing.PIECE
        u = int(hashlib.md5(f"mix:{i}:1".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        out[i] = n
    return {i: n for i, n in out.items() if n}


def test_pipeline(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark woods at night"
    near = base.replace("night", "dawn")
    other = "el perro come mucho pan y bebe agua fresca en la casa grande de su amigo cerca del mar azul"
    texts = [base, base, near, other, None, "12 34", "", other + " siempre", "una cosa muy distinta pasa hoy en otro lugar del mundo entero sin que nadie lo sepa"]
    rows = [(i, t, "es" if t and "p" in t and i in (3, 7, 8) else "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.exact and r.n_tokens == len(r.ids) // 4 > 0 for r in got)
    # documents without a language go; of the equal ones 1 stays, of {1, 2} and of {3, 7} the smaller; mixing repeats these
    want = copies([(1, "s1"), (3, "s1"), (8, "s0")])
    assert Counter(r.doc_id for r in got) == want
    lib = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    assert all(np.frombuffer(r.ids, "<u4").tolist() == lib.encode(texts[r.doc_id], add_special_tokens=False).ids for r in got)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Extra columns with names that operators use, repeated and null ids, a text of 200,000 words; and no row at all."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [words(200_000), words(30), words(30), words(30), None]
    rows = [(i, t, "en", "s", 7, 8, 9, 10) for i, t in zip([1, None, 5, 5, None], texts)] + [(5, texts[3], "en", "s", 7, 8, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _copy int, row int, maybe int, `a.b` int")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns, name
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", texts[0]), ("None", texts[1]), ("5", texts[2]), ("5", texts[3])])
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert all(r.exact for r in got) and {r.doc_id for r in got} <= {1, None, 5}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
