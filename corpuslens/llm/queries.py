"""The registered queries of this subpackage: thin digests of what the operators give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, near_dedup, neighbours, packing, passages, pii, quality, sharding, toxicity, warc
from . import queries_joins
from ._spark import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "stays")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_report(spark, table(spark, sf_dir, "pages")).drop("has_request")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_near_dedup, op3_passages, op4_quality, op5_sharding, op6_packing, op7_neighbours, op8_decontamination, op9_warc, op10_pii)} | queries_joins.QUERIES
ORACLES = queries_joins.ORACLES | {
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as t, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
        o as (select d, min(page_id) as original from p where n >= 100 group by d)
        select page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest,
               case when n >= 100 and original < page_id then 'revisit' else 'response' end as record_type,
               case when n >= 100 and original < page_id then original end as refers_to
        from p left join o on p.d = o.d""",
    "op8_decontamination": r"""
        with bw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
        win as (select distinct cast(item_id as varchar) as item_id, least(10, len(w)) as size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win
                from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from bw where len(w) > 0)),
        dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        sizes as (select distinct size from win),
        docwin as (select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as win
                   from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, sizes where len(w) >= size)),
        hits as (select doc_id, i, docwin.size, item_id from docwin join win on docwin.win = win.win and docwin.size = win.size),
        words as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + size)) as pos from hits) group by doc_id),
        items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
        select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from dw left join words on dw.doc_id = words.doc_id left join items on dw.doc_id = items.doc_id""",
}
