"""Queries over views, lists, labels, transcriptions and deliveries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import geography, hierarchy, layers, reading, topics, transcription, views
from .queries import COVER, DETECTIONS, GRAMS, NORMAL, PAGES, detections, forest, map_summary, pages, query, table, tree_bands, verbatim_coverage


@query("select c_custkey as id, round(avg(o_totalprice), 4) as mean from customer left join orders on o_custkey = c_custkey group by 1")
def run_quality(spark, sf):
    runs = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_totalprice").alias("quality_score"))
    return views.run_quality(runs, rows).withColumn("mean", F.round("mean", 4))


@query("""select c_custkey as id, coalesce(t.n, 0) as topics, coalesce(i.n, 0) as instances from customer left join (select o_custkey as k, count(*) as n from orders where o_orderstatus = 'F' group by 1) t on t.k = c_custkey left join (select o_custkey as k, count(*) as n from orders group by 1) i on i.k = c_custkey""")
def run_counts(spark, sf):
    runs, orders = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").withColumnRenamed("o_custkey", "run_id")
    return views.run_counts(runs, orders.filter("o_orderstatus = 'F'"), orders)


@query("select lang, source, count(*) as n from documents group by 1, 2")
def common_values(spark, sf):
    return views.most_common(table(spark, sf, "documents"), "lang", "source")


@query("select source, arg_min(lang, doc_id) filter (where doc_id % 3 = 0) as lang from documents group by 1")
def first_shown_value(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, "").alias("lang"))
    return views.first_shown(docs, "source", "lang", "doc_id")


@query("select n_regionkey as region, string_agg(distinct n_name, ', ' order by n_name) as names from nation group by 1")
def names_by_region(spark, sf):
    return views.names_of(table(spark, sf, "nation").withColumnRenamed("n_regionkey", "region"), "region", "n_name")


@query(f"""with {DETECTIONS}, d as (select topic, count(distinct doc) as documents from det group by topic order by documents desc, topic limit 25), o as (select p_brand as topic, max(p_partkey) as pos from part group by 1) select d.topic, documents, pos from d left join o on d.topic = o.topic""")
def top_topics(spark, sf):
    order = table(spark, sf, "part").groupBy(F.col("p_brand").alias("topic")).agg(F.max("p_partkey").alias("pos"))
    return views.top_topics(topics.distribution(detections(spark, sf), table(spark, sf, "orders").count()), order).select("topic", "documents", "pos")


@query(f"""with {COVER}, c as (select doc, sum(greatest(0, spot + n - greatest(spot, coalesce(before, 0)))) as covered from f group by doc), m as (select distinct doc from p),
    r as (select t.doc, length(t) as length, coalesce(covered, 0) as covered from t join m on t.doc = m.doc left join c on t.doc = c.doc)
    select doc, cast(covered as bigint) as covered, round(case when length > 0 then covered / length else 0.0 end, 6) as ratio from r order by case when length > 0 then covered / length else 0.0 end, doc limit 8""")
def least_covered(spark, sf):
    return views.least_covered(verbatim_coverage(spark, sf)).select("doc", "covered", F.round("ratio", 6).alias("ratio"))


@query(f"with {PAGES} select page_id from pages_ where quality_score >= 0.9 and length(text) between 800 and 4000")
def gold_candidates(spark, sf):
    return views.gold_candidates(pages(spark, sf)).select("page_id")


@query("select doc_id from documents where case when doc_id % 4 = 0 then null else lang end is null")
def rows_without_place(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("place"))
    return views.of_place(docs, "place", "").select("doc_id")


def small_grid(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("level"), (F.col("r_regionkey") != 2).alias("validated"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(0).alias("level"), (F.col("n_nationkey") % 3 != 0).alias("validated"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return r.unionByName(n)


@query("select 'r' || n_regionkey as source, 'n' || n_nationkey as target from nation where n_nationkey % 3 <> 0 and n_regionkey <> 2")
def shown_edges(spark, sf):
    return views.shown_topics(small_grid(spark, sf), validated=True)[1]


@query("select 'n' || n_nationkey as external_id, r_name as parent_name from nation join region on r_regionkey = n_regionkey union all select 'r' || r_regionkey, null from region")
def topics_with_parents(spark, sf):
    return views.with_parents(small_grid(spark, sf).withColumn("run_id", F.lit(1)).withColumnRenamed("id", "external_id")).select("external_id", "parent_name")


@query("""select o_orderkey as id, case when c_custkey is not null then coalesce(n_name, null) end as place, g.group_id, g.size from orders left join customer on c_custkey = o_custkey and c_custkey % 5 <> 0 left join nation on n_nationkey = c_nationkey
    left join (select o_custkey % 7 as group_id, count(*) as size from orders group by 1) g on g.group_id = o_custkey % 7 and g.group_id % 2 = 1""")
def document_view(spark, sf):
    orders = table(spark, sf, "orders")
    documents = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contribution_id"))
    contributions = table(spark, sf, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("city_code"))
    places = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), F.lit("").alias("official_name"))
    key = F.col("o_custkey") % 7
    groups = orders.groupBy(key.alias("group_id")).agg(F.count("*").alias("size")).withColumn("run_id", F.col("group_id") % 2).withColumn("places", F.lit(1))
    return views.document_view(documents, contributions, places, orders.select(F.col("o_orderkey").alias("id"), key.alias("group_id")), groups, 1).select("id", "place", "group_id", "size")


@query("select doc_id as page_id from documents where doc_id in (select doc_id from labels where toxic = 1)")
def transcribed_pages(spark, sf):
    t = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("run_id"))
    return views.transcribed(table(spark, sf, "documents").select(F.col("doc_id").alias("page_id")), t, 1)


SPAN = "select l_orderkey as id, l_linenumber * 5 as start, cast(l_linenumber * 5 + l_quantity % 9 as bigint) as stop, l_linenumber from lineitem"


@query(f"with s as ({SPAN}) select id, start, stop as \"end\" from s a where l_linenumber % 2 = 0 and exists (select 1 from s b where b.id = a.id and b.l_linenumber % 2 = 1 and a.start < b.stop and b.start < a.stop)")
def overlapping_spans(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 5).alias("start"), (F.col("l_linenumber") * 5 + F.col("l_quantity") % 9).cast("long").alias("end"), "l_linenumber")
    return views.overlapping(s.filter("l_linenumber % 2 = 0"), s.filter("l_linenumber % 2 = 1")).select("id", "start", "end")


@query("""select l_orderkey as document_id, l_linenumber as place, p_brand as name, coalesce(o_orderstatus, c_mktsegment) as register from lineitem join part on p_partkey = l_partkey and p_size > 10 left join orders on o_orderkey = l_orderkey and o_orderkey % 3 <> 0 left join customer on c_custkey = l_suppkey""")
def topic_occurrences(spark, sf):
    i = table(spark, sf, "lineitem").select(F.lit(1).alias("run_id"), F.col("l_partkey").alias("topic"), F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("contribution_id"), F.col("l_linenumber").alias("verbatim"))
    t = table(spark, sf, "part").filter("p_size > 10").select(F.lit(1).alias("run_id"), F.col("p_partkey").alias("external_id"), F.col("p_brand").alias("name"))
    d = table(spark, sf, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("register"), F.lit(1).alias("start_page"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("pdf_file"), F.lit(2).alias("start_page"))
    return views.occurrences(i, t, d, c).select("document_id", F.col("verbatim").alias("place"), "name", "register")


@query(r"""with g as (select doc_id % 50 as contribution_id, string_agg(text, chr(10) order by doc_id) as t from documents group by 1) select contribution_id, cast(len(list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> '')) as integer) as lines, cast(len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) as integer) as words from g""")
def reading_labels(spark, sf):
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("contribution_id"), F.col("doc_id").alias("page"), "text", F.lit("native").alias("source"))
    return views.reading_labels(rows).select("contribution_id", "lines", "words")


@query("select c_custkey as code, round(sqrt(greatest(c_acctbal, 0)) / max(sqrt(greatest(c_acctbal, 0))) over (), 6) as size from customer")
def map_points(spark, sf):
    return views.map_points(map_summary(spark, sf)).select("code", F.round("size", 6).alias("size"))


@query("""with recursive nodes as (select 'r' || r_regionkey as node, null as parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),
    closed as (select node as ancestor, node, 0 as distance from nodes union all select n.parent, c.node, distance + 1 from closed c join nodes n on c.ancestor = n.node where n.parent is not null),
    h as (select ancestor, max(distance) + 1 as height from closed group by 1), b as (select case when height >= 5 then 'A' when height >= 3 then 'B' else 'C' end as band from h)
    select x.band, count(b.band) as trees, round(count(b.band) * 100.0::double / (select count(*) from b), 6) as share from (select unnest(['A', 'B', 'C']) as band) x left join b on b.band = x.band group by 1""")
def band_shares(spark, sf):
    return views.band_table(tree_bands(spark, sf)).withColumn("share", F.round("share", 6))


@query("""select l_orderkey, l_linenumber, case when l_linenumber = l_quantity::int then 'p. ' || l_linenumber else 'p. ' || l_linenumber || '-' || l_quantity::int end as pages, printf('%.1f %%', round(l_linenumber * 100.0::double / l_quantity::double, 1)) as share, case when l_returnflag = 'N' then 'N/C' when l_returnflag = 'R' then 'oui' else 'non' end as returned from lineitem""")
def line_labels(spark, sf):
    q = F.col("l_quantity").cast("int")
    back = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", views.page_range(F.col("l_linenumber"), q).alias("pages"), views.percent(F.col("l_linenumber"), F.col("l_quantity").cast("double")).alias("share"), views.yes_no(back).alias("returned"))


@query(f"with {GRAMS} select doc_id as page_id from flags where is_drift and doc_id % 2 = 1")
def drift_to_redo(spark, sf):
    t = table(spark, sf, "documents").select((F.col("doc_id") % 2).alias("run_id"), F.col("doc_id").alias("page_id"), "text")
    return transcription.take_back_drift(t, 1)[1]


@query("""with recursive s as (select row_number() over (order by doc_id) as k, doc_id as id, strlen(text) as n from documents), f as (select k, id, n as fill, 0::bigint as lot from s where k = 1
    union all select s.k, s.id, case when fill + n > 50000 then n else fill + n end, case when fill + n > 50000 then lot + 1 else lot end from f join s on s.k = f.k + 1) select id, lot from f""")
def request_lots(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size"))
    return transcription.lots(rows, limit=50_000).select("id", "lot")


@query("""with t as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as other from conversations) select conv_id, turn, round(length(other) / length(text)::double, 6) as length_ratio from t where other is not null and length(text) > 0""")
def length_ratios(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("text_b", F.lead("text").over(w)).filter("text_b is not null and length(text) > 0")
    found = transcription.fidelity(rows.select(F.struct("conv_id", "turn").alias("page_id"), F.col("text").alias("reference"), F.col("text_b").alias("text")))
    return found.select("page_id.conv_id", "page_id.turn", F.round("length_ratio", 6).alias("length_ratio"))


@query("select p_brand as topic, l_orderkey as doc, sum(case when l_linenumber % 2 = 0 then 2 else 1 end)::bigint as n from lineitem join part on l_partkey = p_partkey group by 1, 2")
def weighted_detections(spark, sf):
    i = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = i.select(F.col("p_brand").alias("topic"), F.col("l_orderkey").alias("doc"), F.when(F.col("l_linenumber") % 2 == 0, "mots-clés : a, b").otherwise("said").alias("summary"))
    return topics.weighted_detections(rows)


@query("select cast(s_suppkey as varchar) as external_id from supplier where s_suppkey % 3 <> 0 and s_suppkey * 2 not in (select s_suppkey from supplier)")
def delivered_orphans(spark, sf):
    s = table(spark, sf, "supplier")
    delivered = s.select(F.col("s_suppkey").cast("string").alias("external_id"), F.when(F.col("s_suppkey") % 3 != 0, (F.col("s_suppkey") * 2).cast("string")).alias("parent"))
    return layers.orphans(delivered, delivered.limit(0)).select("external_id")


@query("select p_type || ' ' || p_size as name, count(*) as n from part where p_size >= 20 group by 1")
def dropped_labels(spark, sf):
    p = table(spark, sf, "part").withColumn("name", F.concat_ws(" ", "p_type", F.col("p_size").cast("string")))
    said = p.select(F.col("p_partkey").cast("string").alias("external_doc_id"), F.array(F.struct("name", F.lit("r").alias("rationale"), F.lit("e").alias("extract"))).alias("labels"))
    return layers.unknown_labels(said, p.filter("p_size < 20").select("name").distinct())


OPENED = "l as (select l_orderkey as register, l_linenumber as page, min(case when l_returnflag <> 'N' then cast(cast(l_shipdate as date) as varchar) end) as city from lineitem group by 1, 2)"


@query(f"with {OPENED} select register, page as position, (select arg_min(x.city, x.page) from l x where x.register = l.register and x.page >= l.page) as city from l where page % 2 = 1")
def segment_cities(spark, sf):
    day = F.col("l_shipdate").cast("date").cast("string")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("register"), F.col("l_linenumber").alias("page")).agg(F.coalesce(F.min(F.when(F.col("l_returnflag") != "N", day)), F.lit(" ")).alias("city")).withColumn("contribution_id", F.lit(1))
    segments = rows.filter("page % 2 = 1").select("register", F.col("page").alias("position"), F.col("page").alias("start_page"))
    return layers.segment_rows(segments, rows).select("register", "position", "city")


@query("""select code, name, kind from (select cast(c_custkey // 2 as varchar) as code, c_name as name, case when c_custkey % 2 = 0 then 'COMD' else 'COM' end as kind, row_number() over (partition by c_custkey // 2 order by c_custkey % 2 desc, c_name) as k from customer where c_nationkey < 10) where k = 1""")
def pivot_places(spark, sf):
    rows = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 2).cast("string").alias("code"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "COMD").otherwise("COM").alias("kind"), F.lit(None).cast("string").alias("parent_code"), F.col("c_nationkey").cast("string").alias("department"))
    return geography.pivot_places(rows, [str(i) for i in range(10)]).select("code", "name", "kind")


@query(f"with n as (select doc_id, list_filter(string_split({NORMAL.format('text')}, ' '), lambda w: length(w) > 1 and w not in ('the', 'der', 'les', 'que')) as w from documents) select doc_id, len(w) as n, md5(array_to_string(w, ' ')) as digest from n")
def embedding_words(spark, sf):
    own = T.embedding_words(F.col("text"), F.array(*[F.lit(w) for w in ("the", "der", "les", "que")]))
    docs = table(spark, sf, "documents").select("doc_id", own.alias("w"))
    return docs.select("doc_id", F.size(F.filter(F.split("w", " "), lambda x: x != "")).cast("long").alias("n"), F.md5("w").alias("digest"))


@query(f"with {PAGES} select page_id from pages_ where needs_ocr is not distinct from true or (needs_ocr is not distinct from false and quality_score < 0.6)")
def perimeter_pages(spark, sf):
    return reading.perimeter(pages(spark, sf), "manuscrit+suspect").select("page_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def new_rows(spark, sf):
    return reading.new_rows(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


TREES = """with recursive nodes as (select 'r' || r_regionkey as node, null as parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),
    closed as (select node as ancestor, node, 0 as distance from nodes union all select n.parent, c.node, distance + 1 from closed c join nodes n on c.ancestor = n.node where n.parent is not null)"""


@query(f"""{TREES}, d as (select 's' || l_suppkey as node, count(*) as n from lineitem where l_suppkey % 2 = 0 group by 1), t as (select ancestor as root, count(*) as nodes, max(distance) + 1 as height, coalesce(sum(n), 0)::bigint as detections from closed c left join d on d.node = c.node where ancestor like 'r%' group by 1)
    select root, nodes, height, case when height >= 5 then 'A' when height >= 3 then 'B' else 'C' end as band, detections from t where detections > 0""")
def detected_trees(spark, sf):
    nodes = forest(spark, sf)
    counts = table(spark, sf, "lineitem").filter("l_suppkey % 2 = 0").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("node")).agg(F.count("*").alias("n"))
    return hierarchy.trees(nodes, hierarchy.closure(nodes), counts)


@query(f"""{TREES}, d as (select 's' || l_suppkey as node, count(*) as n from lineitem group by 1), t as (select ancestor as node, sum(n)::bigint as total from closed c join d on d.node = c.node group by 1)
    select n.node, n.parent, coalesce(total, 0) as total from nodes n left join t on t.node = n.node where n.node not like 's%'""")
def overview_skeleton(spark, sf):
    nodes = forest(spark, sf)
    closed = hierarchy.closure(nodes)
    counts = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("node")).agg(F.count("*").alias("n"))
    return hierarchy.skeleton(nodes, closed, hierarchy.roll_up(closed, counts), 1).select("node", "parent", "total")
