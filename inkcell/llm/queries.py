"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, edit_tokens, langid, ngram_join, packing, quality, suffix_dedup, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # alone in its workers, packing can keep more words
    return packing.pack(table(spark, sf_dir, "documents"), word_vocabulary(), cache=2 * packing.CACHE_WORDS)


def op2_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP2_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item, least(len(w), 10) as m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
  from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)
), m as (select distinct m from bw),
dw as (
  select doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as win
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, m where len(w) >= m)
), hit as (select distinct doc_id, i, m, item from dw join bw using (m, win)),
pos as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(i, i + m)) as p from hit) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join it using (doc_id)
"""

def op3_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
g as (select body, max(page_id) as last, count(*) as n from p group by body),
b as (select page_id, octet_length(encode(body))::bigint as payload_bytes, last, n, sha1(body) as hex from p join g using (body)),
v as (
  -- SHA-1 is 160 bits: eight groups of 20 bits, each four base32 digits
  select *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (1 + 5 * i)::bigint, 5))::bigint) as w from b
)
select page_id, payload_bytes,
  list_aggregate(list_transform(w, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32768) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 1024) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), 'string_agg', '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id = last then null else last end as refers_to
from v
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.copies(table(spark, sf_dir, "documents")))


def op6_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op7_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op8_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return edit_tokens.self_edits(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_blocked_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_lattice_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_winnowing_decontamination": op2_winnowing_decontamination,
    "op3_additive_quality": op3_additive_quality,
    "op4_dictionary_warc": op4_dictionary_warc,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_norm_sorted_top_k": op6_norm_sorted_top_k,
    "op7_ppm_language_id": op7_ppm_language_id,
    "op8_edit_aware_counts": op8_edit_aware_counts,
    "op9_blocked_jaccard": op9_blocked_jaccard,
    "op10_lattice_toxicity": op10_lattice_toxicity,
}
SQL: dict[str, str] = {"op2_winnowing_decontamination": OP2_SQL, "op4_dictionary_warc": OP4_SQL, "op6_norm_sorted_top_k": OP6_SQL}
