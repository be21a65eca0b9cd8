"""Registered queries of ranked search, vector codes and the set join, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import codes, ranked, setjoin
from ._spark import table


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_report(table(spark, sf_dir, "embeddings"))


def op13_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.shingle_join(table(spark, sf_dir, "documents"))


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds spelled out, one after the other, over rows of single components."""
    steps = [
        """kept as (select vec_id, label, embedding from embeddings where embedding is not null
                    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""points as materialized (select vec_id, (i - 1) // (n // {parts}) as part, (i - 1) % (n // {parts}) as pos, cast(floor(1024 * cast(embedding[i] as double)) as bigint) as x
                    from (select vec_id, embedding, len(embedding) as n, unnest(range(1, len(embedding) + 1)) as i from kept))""",
        f"chosen as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < {entries})",
        "book0 as materialized (select part, entry, pos, x as c from points join chosen using (vec_id))",
    ]
    for turn in range(rounds + 1):
        steps.append(f"""far{turn} as (select vec_id, points.part, entry, sum((x - c) * (x - c)) as d
                    from points join book{turn} on points.part = book{turn}.part and points.pos = book{turn}.pos group by all)""")
        steps.append(f"near{turn} as materialized (select vec_id, part, min(d) as d, arg_min(entry, (d, entry)) as entry from far{turn} group by all)")
        if turn < rounds:
            steps.append(f"""sums{turn} as (select points.part, entry, pos, sum(x) as s, count(*) as n from points join near{turn} using (vec_id, part) group by all)""")
            steps.append(f"""book{turn + 1} as materialized (select part, entry, pos, cast(coalesce((s - ((s % n) + n) % n) // n, c) as bigint) as c
                    from book{turn} left join sums{turn} using (part, entry, pos))""")
    steps.append(f"""coded as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from near{rounds} group by vec_id)""")
    return f"""with {", ".join(steps)}
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
               (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) from book{rounds}) as codebooks_sha256
        from coded join kept using (vec_id)"""


QUERIES = {f.__name__: f for f in (op11_ranked_search, op12_vector_codes, op13_shingle_join)}
ORACLES = {
    "op11_ranked_search": r"""
        with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null),
        long as (select doc_id, cast(len(w) as bigint) as n, w from d where len(w) > 0),
        corpus as (select count(*) as docs, cast(sum(n) as bigint) as terms from long),
        held as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(w) as term from long) group by all),
        weights as (select term, cast(floor(1000 * ln(cast(2 * any_value(docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as weight from held, corpus group by term),
        asked as (select distinct item_id, text from benchmark where text is not null),
        words as (select item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from asked),
        scored as (select item_id, text, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) as bigint) as score
                   from words join held using (term) join weights using (term), corpus group by item_id, text, doc_id)
        select item_id, cast(row_number() over (partition by item_id, text order by score desc, doc_id) as integer) as rank, doc_id, score
        from scored where score > 0 qualify rank <= 20""",
    "op12_vector_codes": _codes_sql(),
    "op13_shingle_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as materialized (select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as shingle
              from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from w where len(w) > 0)),
        sizes as (select doc_id, count(*) as n from s group by doc_id),
        links as materialized (select a.doc_id as x, b.doc_id as y from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id
                  join sizes p on p.doc_id = a.doc_id join sizes q on q.doc_id = b.doc_id
                  where 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
                  group by a.doc_id, b.doc_id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))),
        reach as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x)
        select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(least(w.doc_id, c), w.doc_id) as component_id
        from w left join sizes on w.doc_id = sizes.doc_id left join (select x, min(y) as c from reach group by x) on w.doc_id = x""",
}
