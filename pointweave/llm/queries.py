"""The registered queries of this subpackage and, where SQL can express them, the DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import bpe, exact_dedup, html, jaccard, langid, media, mixing, quality, tokens, warc
from pointweave.llm.common import table

#: The tokenizer files of the queries; the operators take any path.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

QUERIES: dict = {}
ORACLES: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.write(warc.pages_as_captures(table(spark, sf_dir, "pages")))
    return warc.read(spark, made, warc.merged(spark, made))


ORACLES["op2_warc"] = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
    url, regexp_extract(coalesce(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1) as host,
    regexp_replace(coalesce(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*', '') as rest from pages),
k as (select *, array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' ||
    regexp_extract(rest, '^[^#]*', 0) as url_key,
    max(page_id) over (partition by payload_digest) as last from p)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= {warc.MIN_REVISIT} and page_id <> last then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= {warc.MIN_REVISIT} and page_id <> last then last end as refers_to,
    url_key, row_number() over (order by url_key, page_id) - 1 as position
from k
"""


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights for all sources, as many copies as documents."""
    return mixing.mix(table(spark, sf_dir, "documents"), names=("copy", "shuffle_key"))


ORACLES["op5_mix_sources"] = f"""
with recursive size as (select source, count(*) n from documents group by source),
rate as (select source, cast(1 as double) / (select cast(count(*) as double) from size) * (select cast(count(*) as double) from documents)
         * cast(1 as double) / n rate from size),
piece as (select source, greatest(1, cast(ceil(rate / {mixing.PIECE}) as int)) pieces, rate from rate),
term as (
  select source, 0 k, exp(-(rate / pieces)) p, exp(-(rate / pieces)) cdf, rate / pieces m from piece
  union all
  select source, k + 1, p * m / (k + 1), cdf + p * m / (k + 1), m from term where k < {mixing.TERMS}),
draw as (
  select d.doc_id, d.source, i, cast('0x' || substr(md5('mix:' || coalesce(cast(d.doc_id as varchar), '') || ':' || i), 1, 13) as bigint) / 4503599627370496.0::double u
  from documents d join piece p on d.source is not distinct from p.source, unnest(range(1, p.pieces + 1)) t(i)),
drawn as (select doc_id, count(cdf) c from draw left join term on draw.source is not distinct from term.source and cdf <= u group by doc_id)
select d.*, copy::int as copy, md5('mix:' || coalesce(cast(d.doc_id as varchar), '') || ':copy:' || copy) shuffle_key
from documents d join drawn on d.doc_id is not distinct from drawn.doc_id, unnest(range(1, c + 1)) t(copy)
"""


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(table(spark, sf_dir, "documents"))


ORACLES["op6_exact_dedup"] = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


@query
def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


@query
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read(spark, tokens.write(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), 2))
