"""Views, transcriptions, entities, the topic loop, deliveries, geography, files and the command
line, on small fixtures."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpuslens import fixed, schemas
from corpuslens import __main__ as cli
from corpuslens.functions import sql
from corpuslens.functions import text as T
from corpuslens.operators import coverage, entities, evaluation, geography, layers, reading, taxonomy, topicloop, topics, transcription, views
from corpuslens.sources import files, sinks


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for the clients sent to workers


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


# Views
def test_document_view_keeps_the_run_in_the_join(spark):
    documents = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id long, contribution_id long")
    contributions = spark.createDataFrame([(10, "01001"), (20, None)], "id long, city_code string")
    places = spark.createDataFrame([("01001", "Own", "")], "code string, name string, official_name string")
    members = spark.createDataFrame([(1, 1), (2, 1), (1, 9)], "id long, group_id long")
    groups = spark.createDataFrame([(1, 7, 2, 2), (9, 8, 2, 1)], "group_id long, run_id long, size long, places long")
    got = views.document_view(documents, contributions, places, members, groups, 7)
    assert sorted((r["id"], r["place"], r["group_id"]) for r in got.collect()) == [(1, "Own", 1), (2, None, 1), (3, None, None)]
    assert views.document_view(documents, contributions, places, members, groups, None).filter("group_id is not null").isEmpty()


def test_occurrences_parents_and_filters(spark):
    instances = spark.createDataFrame([(5, "t", 1, None, "x"), (5, "t", None, 10, "y"), (5, "gone", 1, None, "z")], "run_id long, topic string, document_id long, contribution_id long, verbatim string")
    grid = spark.createDataFrame([(5, "t", "Gare", "p"), (5, "p", "Transport", None), (6, "p", "Other", None)], "run_id long, external_id string, name string, parent string")
    documents = spark.createDataFrame([(1, "reg1", 3)], "id long, register string, start_page int")
    contributions = spark.createDataFrame([(10, "file.pdf", 4)], "id long, pdf_file string, start_page int")
    assert rows_of(views.occurrences(instances, grid, documents, contributions), "verbatim", "register", "page", "name") == [("x", "reg1", 3, "Gare"), ("y", "file.pdf", 4, "Gare")]
    assert sorted((r["run_id"], r["external_id"], r["parent_name"]) for r in views.with_parents(grid).collect()) == [(5, "p", None), (5, "t", "Transport"), (6, "p", None)]
    t = spark.createDataFrame([("a", "A", 1, True, None, ["d1"]), ("b", "B", 0, True, "a", ["d1", "d2"]), ("c", "C", 0, False, "a", [])], "id string, name string, level int, validated boolean, parent string, sources array<string>")
    assert rows_of(views.topics_from(t, "d1"), "id") == [("a",), ("b",)] and rows_of(views.topics_named(t, ["A", "B"], 0), "id") == [("b",)] and views.topics_named(t, []).isEmpty()
    kept, edges = views.shown_topics(t, 0, validated=True)
    assert rows_of(kept, "id") == [("a",), ("b",)] and rows_of(edges) == [("a", "b")]
    assert views.shown_topics(t, 1)[1].isEmpty()
    runs = spark.createDataFrame([(1, "analyse", "segmentation:3"), (2, "analyse", "segmentation:4"), (3, "doublons", "segmentation:3")], "id long, kind string, corpus string")
    assert rows_of(views.grids_reading(runs, 3), "id") == [(1,)]


def test_overlap_first_value_and_place(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 5)], "id long, start int, end int")
    b = spark.createDataFrame([(1, 4, 5), (2, 5, 6)], "id long, start int, end int")
    assert rows_of(views.overlapping(a, b), "id", "start") == [(1, 0)]
    v = spark.createDataFrame([("k", 1, None), ("k", 2, ""), ("k", 3, "x"), ("k", 4, "y"), ("e", 1, None)], "k string, page int, v string")
    assert {r["k"]: r["v"] for r in views.first_shown(v, "k", "v", "page").collect()} == {"k": "x", "e": None}
    p = spark.createDataFrame([(1, "A"), (2, None)], "id long, place string")
    assert rows_of(views.of_place(p, "place", ""), "id") == [(2,)] and rows_of(views.of_place(p, "place", "A"), "id") == [(1,)]


def test_labels_and_reports(spark):
    df = spark.createDataFrame([(None, True, 3, 3, "u"), ("", False, 3, 5, None), ("x", None, None, 5, "u")], "s string, b boolean, f int, l int, url string")
    got = df.select(views.shown(F.col("s")).alias("s"), views.yes_no(F.col("b")).alias("b"), views.page_range(F.col("f"), F.col("l")).alias("p"), views.page_link(F.col("url"), F.col("f")).alias("k"), views.percent(F.col("f"), F.col("l")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("N/C", "oui", "p. 3", "u#page=4", "100.0 %"), ("N/C", "non", "p. 3-5", None, "60.0 %"), ("x", "N/C", "N/C", None, "N/C")]
    assert spark.range(1).select(views.bullets(F.array(F.lit("a"), F.lit("b"))).alias("x")).first()["x"] == "- a\n- b"
    assert views.report_lines(spark.createDataFrame([(1, None)], "n int, m string"), "n", "m").first()["line"] == "n: 1, m: N/C"
    bands = spark.createDataFrame([("a", "A"), ("b", "C"), ("c", "C")], "node string, band string")
    assert {r["band"]: (r["trees"], round(r["share"], 1)) for r in views.band_table(bands).collect()} == {"A": (1, 33.3), "B": (0, 0.0), "C": (2, 66.7)}
    pages = spark.createDataFrame([(1, 1, "b c\n\nd", "native"), (1, 0, "a", "transcription")], "contribution_id long, page int, text string, source string")
    r = views.reading_labels(pages).first()
    assert (r["source"], r["lines"], r["words"], r["text"]) == ("transcription", 3, 4, "a\nb c\n\nd")


# Transcriptions
def test_transcriptions_redraw_resume_and_take_back(spark):
    images = spark.createDataFrame([(1, bytearray(b"une page")), (2, None), (3, bytearray(b"deux pages"))], "page_id long, image binary")
    got = {r["page_id"]: r for r in transcription.transcribe(images, transcription.Echo(drifting=(0, 1))).collect()}
    assert got[1]["text"] == "une page" and (got[1]["seed"], got[1]["redraws"], got[1]["error"]) == (2, 2, None) and got[2]["error"] == "no image"
    stuck = {r["page_id"]: r for r in transcription.transcribe(images, transcription.Echo(drifting=(0, 1, 2, 3))).collect()}
    assert stuck[1]["redraws"] == 3 and stuck[1]["text"].startswith("une page\nune page")
    table = spark.createDataFrame([(5, 1, "ok"), (5, 3, "la ligne\n" * 60), (6, 3, "la ligne\n" * 60)], "run_id long, page_id long, text string")
    left, again = transcription.take_back_drift(table, 5)
    assert rows_of(left, "run_id", "page_id") == [(5, 1), (6, 3)] and rows_of(again) == [(3,)]
    assert rows_of(transcription.still_to_do(images.select("page_id"), left, 5)) == [(2,), (3,)]
    drawn = transcription.render(spark.createDataFrame([(1, "f", 0), (2, "f", 9)], "page_id long, file string, page int"), lambda file, page, dpi, kind: [b"image"][page])
    assert {r["page_id"]: (r["image"] and bytes(r["image"]), r["error"]) for r in drawn.collect()} == {1: (b"image", None), 2: (None, "list index out of range")}


def test_drift_by_hand(spark):
    many = " ".join(f"m{i}" for i in range(2001))
    cases = [("", False), ("a " * 99, False), ("a " * 100, True), ("x\n" * 49, False), ("x\n" * 50, True), (many, True), (many.rsplit(" ", 1)[0], False), ("y" * 12001, True), ("y" * 12000, False), (" ".join(f"u{i}" for i in range(120)), False)]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(T.is_drift(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in got] == [d for _, d in cases]


def greedy(sizes, limit):
    """Lots filled one request after the other."""
    out, lot, fill = [], -1, None
    for n in sizes:
        if fill is None or fill + n > limit:
            lot, fill = lot + 1, 0
        fill += n
        out.append(lot)
    return out


@pytest.mark.parametrize("sizes", [[10] * 60 + [5000] + [10] * 40, [5000, 5000, 1, 1000, 1, 999, 1000, 1001, 3], [1] * 30, [1000] * 5, [0, 0, 1000, 0, 1], [7]])
def test_lots_are_filled_greedily(spark, sizes):
    rows = [(i * 2, n) for i, n in enumerate(sizes)]
    got = [r["lot"] for r in transcription.lots(spark.createDataFrame(rows, "id long, size long"), limit=1000, parts=5).orderBy("id").collect()]
    assert got == greedy(sizes, 1000)
    assert len(set(greedy([10] * 100 + [5000], 1000))) == 2


def test_upsert_one_row_a_key(spark):
    table = spark.createDataFrame([(1, "a", 0), (None, "n", 0), (2, "b", 0)], "k long, v string, t int")
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "m", 1), (3, "z", 1)], "k long, v string, t int")
    got = {r["k"]: r["v"] for r in layers.upsert(table, changes, "k", order="t").collect()}
    assert got == {1: "y", None: "m", 2: "b", 3: "z"} and layers.upsert(table, changes, "k", order="t").count() == 4


def test_surplus_goes_from_the_largest(spark):
    rows = [(i, n) for i, n in enumerate([1] * 400 + [2] * 400 + [3] * 12)]
    drawn = evaluation.stratified_sample(spark.createDataFrame(rows, "k long, n int"), "k", "n", size=60)
    assert sorted(r["count"] for r in drawn.groupBy("stratum").count().collect()) == [10, 20, 30]


def test_fidelity_and_lots(spark):
    pairs = spark.createDataFrame([(1, "Été chaud", "ete chaud", True), (2, "", "x", None), (3, "a b c d", "a b c d", False)], "page_id long, reference string, text string, capped boolean")
    got = {r["page_id"]: r for r in transcription.fidelity(pairs).collect()}
    assert got[1]["folded_cer"] == 0 and got[1]["wer"] == 0.5 and got[1]["capped"] and got[1]["cer"] == pytest.approx(2 / 9)
    assert got[2]["cer"] == got[2]["wer"] == 1 and got[2]["length_ratio"] is None and got[3]["cer"] == got[3]["wer"] == 0
    rates = evaluation.error_rates(spark.createDataFrame([(0.0, 10), (0.5, 30)], "cer double, n int"), "cer", "n").first()
    assert (rates["mean"], rates["largest"], rates["weighted"]) == (0.25, 0.5, 0.375)
    rng = random.Random(1)
    sizes = [(i * 3, rng.randint(1, 40)) for i in range(500)]
    lots = transcription.lots(spark.createDataFrame(sizes, "id long, size long"), limit=200, parts=7).orderBy("id").collect()
    numbers = [r["lot"] for r in lots]
    held = {}
    for (_, n), lot in zip(sizes, numbers):
        held[lot] = held.get(lot, 0) + n
    assert numbers == greedy([n for _, n in sizes], 200) and max(held.values()) <= 200
    assert transcription.lots(spark.createDataFrame([], "id long, size long")).count() == 0
    asked = transcription.requests(spark.createDataFrame([(1, bytearray(b"i")), (2, None)], "page_id long, image binary"), "read", "m").collect()
    assert len(asked) == 1 and json.loads(asked[0]["line"])["body"]["image"] == "aQ==" and asked[0]["size"] == len(asked[0]["line"]) + 1


# Entities
def test_entities_of_a_model(spark):
    text = "Bonjour. " * 200 + "Jean Petit habite Lyon, écrire à jean@x.fr. " + "Fin. " * 300
    chunks = entities.chunks_of(text)
    assert all(len(c) <= fixed.NER_CHARS for _, c in chunks) and all(text[a : a + len(c)] == c for a, c in chunks) and "".join(c for _, c in chunks) == text
    assert [len(c) for _, c in entities.chunks_of("z" * 3000)] == [1200, 1200, 600] and entities.chunks_of("") == []

    def model(chunk):
        for name, kind, score in (("Jean Petit", "nom", 0.5), ("(Lyon,", "lieu", 0.7), ("jean@x.fr", "lieu", 0.9), ("Fin", "nom", 0.1), ("Bonjour", "autre", 1.0)):
            at = chunk.find(name.strip("("))
            if at >= 0:
                yield at - (name[0] == "("), at - (name[0] == "(") + len(name), kind, score

    got = {(text[r["start"] : r["end"]], r["kind"]) for r in entities.detect_with(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), model).collect()}
    assert {("Jean Petit", "nom"), ("Lyon", "lieu"), ("jean@x.fr", "email")} <= got and not any(k in ("autre",) or t == "Fin" for t, k in got)


# The topic loop
def fake_client(prompts):
    out = []
    for p in prompts:
        first, _, rest = p.partition("\n")
        names = [line.split(". ", 1)[1].replace(" [validated]", "") for line in rest.split("\n") if ". " in line[:5]]
        if "List the topics" in first:
            out.append(json.dumps({"topics": [{"name": w, "description": f"about {w}"} for w in dict.fromkeys(rest.split()) if w[0].isupper()]}))
        elif "mean the same" in first:
            out.append(json.dumps({"groups": [{"target": names[0], "merged": names[1:] + ["Nothing like it at all"][:0]}]}))
        elif "wider topics" in first:
            out.append(json.dumps({"parents": [{"name": "Wide", "description": "w", "children": names}]}))
        else:
            out.append(json.dumps({"labels": [{"name": n, "rationale": "r1", "extract": "e1"} for n in names] + [{"name": names[0], "rationale": "r2", "extract": "e2"}, {"name": "Unheard", "rationale": "", "extract": ""}]}))
    return [x if i != 99 else "no json" for i, x in enumerate(out)]


def test_topic_loop_with_a_fake_client(spark):
    docs = spark.createDataFrame([("d1", "Gare ici et Train la"), ("d2", "Gare encore et Impots"), ("d3", " ")], "doc string, text string")
    grid = topicloop.discover(docs, fake_client, words=50)
    assert {r["name"]: r["sources"] for r in grid.collect()} == {"Gare": ["d1", "d2"], "Train": ["d1"], "Impots": ["d2"]}
    assert topicloop.discover(docs, lambda ps: ["not json"] * len(ps)).count() == 0
    ids = {r["name"]: r["id"] for r in grid.collect()}
    clusters = spark.createDataFrame([(ids["Gare"], 1), (ids["Train"], 1), (ids["Impots"], 2)], "id string, cluster long")
    merged = topicloop.factorise(grid, clusters, fake_client)
    assert {r["name"]: sorted(r["sources"]) for r in merged.collect()} == {"Gare": ["d1", "d2"], "Impots": ["d2"]}
    tall = topicloop.discover_parents(grid, clusters, fake_client)
    by = {r["name"]: r for r in tall.collect()}
    assert by["Wide"]["level"] == 1 and by["Gare"]["parent"] == by["Train"]["parent"] == by["Wide"]["id"] and by["Impots"]["parent"] is None
    labels = topicloop.label(docs, grid, fake_client)
    assert {(r["doc"], r["name"]): r["rationale"] for r in labels.collect()} == {("d1", "Gare"): "r2", ("d1", "Train"): "r1", ("d2", "Gare"): "r2", ("d2", "Impots"): "r1"}
    validated = grid.withColumn("validated", F.col("name") == "Train")
    assert topicloop.factorise(validated, clusters, fake_client).count() == 3


def test_nearest_names_and_clusters(spark):
    import difflib

    rng = random.Random(6)
    known = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    asked = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 9))) for _ in range(80)] + ["zz", known[3]]
    all_known = spark.createDataFrame([(k, i) for i, k in enumerate(known)], "name string, pos int")
    got = topics.nearest_name(spark.createDataFrame([(n,) for n in asked] + [(None,)], "name string"), all_known, block=16).collect()
    assert {r["name"]: r["nearest"] for r in got} == {n: max(known, key=lambda k: difflib.SequenceMatcher(None, n or "", k).ratio()) for n in [*asked, None]}
    assert len(got) == len(asked) + 1 and sum(r["compared"] for r in got) < 0.6 * len(asked) * len(known)
    assert topics.nearest_name(spark.createDataFrame([("x",)], "name string"), all_known.limit(0)).first()["nearest"] is None
    grid = spark.createDataFrame([("gare", 0, 0), ("gares", 1, 1)], "name string, pos int, level int")
    assert topics.nearest_name(spark.createDataFrame([("gares",)], "name string"), grid, level=0).first()["nearest"] == "gare"
    vectors = [(0, str(i), [1.0, i / 40, 0.0]) for i in range(40)] + [(0, "far", [0.0, 0.0, 1.0]), (1, "0", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "level int, id string, vector array<double>")
    for rows in (1024, 7):
        got = {(r["level"], r["id"]): r["cluster"] for r in topics.cluster_by_level(df, 0.999, block_rows=rows).collect()}
        assert len({got[0, str(i)] for i in range(40)}) == 1 and len(set(got.values())) == 3
    assert topics.reduced(df, 2).select(F.max(F.size("vector"))).first()[0] == 2


def test_merges_and_prompts(spark):
    t = spark.createDataFrame([("1", "A", "d", ["x"], None, 0, False, 0), ("2", "B", "d", ["y"], None, 0, False, 1), ("3", "C", "d", ["z"], None, 0, True, 2)], "id string, name string, description string, sources array<string>, parent string, level int, validated boolean, pos int")
    merges = spark.createDataFrame([("1", "2"), ("1", "3")], "target string, merged string")
    assert rows_of(taxonomy.insert_merges(t, merges), "id") == [("1",), ("3",)]
    lists = topics.prompts_by_chunk(spark.createDataFrame([(1, 2, "B", True), (1, 1, "A", False)], "chunk int, pos int, name string, validated boolean"))
    assert lists.first()["prompt"] == "1. A\n2. B [validated]"
    weights = topics.weighted_detections(spark.createDataFrame([("t", 1, "mots-clés : a, b"), ("t", 1, "other"), ("t", 2, None)], "topic string, doc long, summary string"))
    assert rows_of(weights) == [("t", 1, 3), ("t", 2, 1)]


# Layers, deliveries, geography
def test_delivery_attaches_or_refuses(spark):
    grid = spark.createDataFrame([], "external_id string, name string, description string, level int, validated boolean, parent string")
    new = spark.createDataFrame([("a", "A\u0000", "d", 0, False, "gone"), ("b", "B", "d", 0, False, "a")], grid.schema)
    said = [("d1", [{"name": "A", "rationale": "r", "extract": "le texte premier"}, {"name": "Z", "rationale": "", "extract": ""}]), ("d2", [{"name": "B", "rationale": "r", "extract": "pas dans le texte"}])]
    delivered = spark.createDataFrame(said, "external_doc_id string, labels array<struct<name:string,rationale:string,extract:string>>")
    contributions = spark.createDataFrame([(10,)], "id long")
    documents = spark.createDataFrame([(1, 10), (2, 10)], "id long, contribution_id long")
    texts = spark.createDataFrame([(1, "Voici  LE texte\npremier."), (2, "rien")], "doc long, text string")
    got = layers.load_delivery(grid, new, delivered, contributions, documents, texts)
    assert got["counts"] == {"tested": 2, "found": 1, "attached": True, "orphans": 1, "dropped": 1}
    assert rows_of(got["instances"], "topic", "document_id") == [("a", 1), ("b", 2)] and {r["external_id"]: r["parent"] for r in got["topics"].collect()} == {"a": None, "b": "a"}
    refused = layers.load_delivery(grid, new, delivered, contributions, documents, texts, least=0.6)
    assert not refused["counts"]["attached"] and refused["instances"].filter("document_id is not null").isEmpty()
    assert layers.missing_targets({"x": "q", "a": "q"}, {"a"}) == {"x"}


def test_pages_segments_and_places(spark):
    pages = spark.createDataFrame([("CC_01200_190411_2B077_XY_77.pdf", 0, "t", None), ("old.pdf", 0, "t", None)], "file string, page int, text string, city string")
    fresh, contributions = layers.insert_pages(pages, spark.createDataFrame([("old.pdf",)], "file string"))
    assert fresh.count() == 1 and contributions.first()["pdf_file"].startswith("CC_")
    own = spark.createDataFrame([("r", 0, 100, ""), ("r", 1, 101, "Ville"), ("r", 2, 102, "Autre")], "register string, page int, contribution_id long, city string")
    segments = spark.createDataFrame([("r", 0, 0), ("r", 1, 2)], "register string, position int, start_page int")
    assert rows_of(layers.segment_rows(segments, own), "position", "contribution_id", "city") == [(0, 100, "Ville"), (1, 102, "Autre")]
    places = spark.createDataFrame([("01001", "KEPT", "01")], "code string, name string, department string")
    c = spark.createDataFrame([("CC_01200_190411_2B077_XY_77.pdf", "PRE", None), ("CC_01200_190411_2B077_XY_78.pdf", "PRÉ", None), ("x.pdf", "no", "01001")], "pdf_file string, city string, city_code string")
    more, coded = layers.populate_places(places, c)
    assert rows_of(more) == [("01001", "KEPT", "01"), ("2B077", "PRÉ", "2B")] and rows_of(coded, "city_code") == [("01001",), ("2B077",), ("2B077",)]
    assert rows_of(layers.populate_places(more, coded)[0]) == rows_of(more)
    ref = spark.createDataFrame([("01001", "Off", "COM", 5, "01001", "New"), ("2B077", "Pre", "COMD", None, None, None)], "code string, name string, kind string, population long, code_courant string, nom_courant string")
    assert rows_of(layers.enrich_places(more, ref), "code", "name", "state") == [("01001", "KEPT", "renamed"), ("2B077", "PRÉ", "delegated")]
    gold = spark.createDataFrame([("r", 0, 1, "aa"), ("r", 0, 2, "bb")], "register string, page int, line int, fingerprint string")
    now = spark.createDataFrame([("r", 0, 1, "aa")], gold.schema)
    assert rows_of(evaluation.misaligned(gold, now), "line") == [(2,)]


def test_reference_builder(spark):
    old = spark.createDataFrame([("1", "Un", "COM", None, "d"), ("1", "Un bis", "COMD", "9", "d"), ("2", "Deux", "COM", None, "d"), ("3", "Trois", "COM", None, "d"), ("4", "Quatre", "COM", None, "e"), ("5", "Cinq", "COM", None, "d")], "code string, name string, kind string, parent_code string, department string")
    people = spark.createDataFrame([("1", 100, 0), ("1", 200, 1)], "code string, population long, pos int")
    where = spark.createDataFrame([("1", 1.123456789, 2.0)], "code string, latitude double, longitude double")
    moves = spark.createDataFrame([("2", "1", "2020-01-01")], "from_code string, to_code string, date string")
    today = spark.createDataFrame([("1", "Un"), ("3", "Tres")], "code string, name string")
    got = {r["code"]: r for r in geography.build_reference(old, people, where, moves, today, ["d"]).collect()}
    assert {c: r["state"] for c, r in got.items()} == {"1": "same", "2": "absorbed", "3": "renamed", "5": "vanished"} and got["1"]["population"] == 100 and got["1"]["latitude"] == 1.12346 and got["1"]["kind"] == "COM"
    assert rows_of(geography.states(spark.createDataFrame([("d", "same"), ("d", "same")], "department string, state string"))) == [("d", "same", 2)]
    shown = spark.createDataFrame([("", "Sp", "1"), ("Off", "Sp", "1"), (None, None, "1")], "o string, s string, c string").select(geography.label(F.col("o"), F.col("s"), F.col("c")).alias("x"))
    assert [r["x"] for r in shown.collect()] == ["Sp (1)", "Off (1)", "1 (1)"]
    table = geography.reference_table(spark.createDataFrame([("1", "COM"), ("2", "COMD")], "code string, kind string"), spark.createDataFrame([("1", 2.0)], "code string, latitude double"), spark.createDataFrame([("9", "8", "n")], "code_2019 string, code_courant string, nom_courant string"))
    assert {r["code"]: r["code_courant"] for r in table.collect()} == {"1": "1", "2": None}


# Reading, text
def test_scan_and_perimeters(spark):
    rows = [("CC_1_x.pdf", p, t) for p, t in enumerate(["front", "front", "une page lisible avec des mots", "ab", f"{fixed.END_MARK} et la suite", "after the end"])] + [("CR_1_x.pdf", 0, "xqz wvt kkk zzz yyy")]
    got = reading.scan_pages(spark.createDataFrame(rows, "file string, page int, text string"), F.array(*[F.lit(w) for w in ("une", "page", "lisible", "avec", "des", "mots")])).collect()
    assert sorted((r["file"], r["page"], r["needs_ocr"]) for r in got) == [("CC_1_x.pdf", 2, False), ("CR_1_x.pdf", 0, True)]
    pages = spark.createDataFrame([(1, True, 0.1), (2, False, 0.5), (3, False, 0.9), (4, None, None)], "id int, needs_ocr boolean, quality_score double")
    assert rows_of(reading.perimeter(pages, "manuscrit+suspect"), "id") == [(1,), (2,)] and reading.perimeter(pages, "tout").count() == 4
    assert rows_of(reading.new_rows(pages, pages.filter("id < 3"), "id"), "id") == [(3,), (4,)]
    df = spark.createDataFrame([("Cahier citoyen\nPré-la-Forêt - 01234\n01234\n", "L'œuvre du maire et le MAIRE", 7)], "t string, w string, i long")
    r = df.select(T.find_city(F.col("t")).alias("c"), T.embedding_words(F.col("w"), F.array(F.lit("le"), F.lit("du"), F.lit("et"))).alias("w"), T.document_key(F.lit("doleance"), F.col("i")).alias("k"), T.needs_ocr(F.col("t"), F.lit(0.1)).alias("n")).first()
    assert tuple(r) == ("PRÉ-LA-FORÊT", "oeuvre maire maire", "d7", True)


# Files and command line
def test_files_taxonomies_labels_and_sinks(spark, tmp_path):
    (tmp_path / "texts" / "sub").mkdir(parents=True)
    (tmp_path / "texts" / "a.txt").write_text("one\ntwo")
    (tmp_path / "texts" / "sub" / "b.md").write_text("three")
    assert [(r["id"].rsplit("/", 1)[1], r["content"]) for r in files.read_texts(spark, str(tmp_path / "texts")).orderBy("id").collect()] == [("a.txt", "one\ntwo"), ("b.md", "three")]
    for name in ("CC_2.pdf", "x/CC_10.pdf", "y/CC_2.pdf"):
        (tmp_path / "pdf" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "pdf" / name).write_bytes(b"x")
    found = files.list_files(spark, str(tmp_path / "pdf"))
    assert files.first_file(found).endswith("pdf/CC_2.pdf")
    with pytest.raises(Exception, match="two files named"):
        files.name_index(found).collect()
    assert files.name_index(found.filter("not contains(path, '/y/')")).count() == 2
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "texts"), pattern="*.txt")
    (tmp_path / "t.json").write_text(json.dumps({"topics": [{"id": "a", "name": "A", "sources": ["d"], "level": 0}, {"id": "b", "name": "B"}]}))
    assert rows_of(files.read_taxonomy(spark, str(tmp_path / "t.json")), "pos", "id") == [(0, "a"), (1, "b")]
    (tmp_path / "l.json").write_text(json.dumps({"documents": [{"id": "d", "labels": [{"name": "A", "extract": "1"}, {"name": "B", "extract": "2"}, {"name": "A", "extract": "3"}]}]}))
    assert [(x["name"], x["extract"]) for x in files.read_labels(spark, str(tmp_path / "l.json")).first()["labels"]] == [("B", "2"), ("A", "3")]
    (tmp_path / "lots").mkdir()
    (tmp_path / "lots" / "1.jsonl").write_text('{"custom_id": "1", "response": "{\\"a\\": 2}"}\n{"custom_id": "2", "response": "broken"}\n')
    answer = spark.range(0).selectExpr("cast(null as int) as a").schema
    got = {r["id"]: r["answer"] for r in files.read_answers(spark, str(tmp_path / "lots"), answer).collect()}
    assert got["1"]["a"] == 2 and (got["2"] is None or got["2"]["a"] is None)
    (tmp_path / "lex.json").write_text(json.dumps({"t": "gare"}))
    assert files.read_lexicon(str(tmp_path / "lex.json")) == {"t": "gare"}
    (tmp_path / "bad.json").write_text(json.dumps({"t": " "}))
    with pytest.raises(ValueError):
        files.read_lexicon(str(tmp_path / "bad.json"))
    sinks.write_place_report(spark.createDataFrame([("a", 1 / 3)], "place string, rate double"), str(tmp_path / "csv"), "rate")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["rate"] == "0.333"
    assert json.loads(sinks.report_json(spark.createDataFrame([(2,), (1,)], "n int")).first()["report"]) == [{"n": 1}, {"n": 2}]
    texts = spark.createDataFrame([("f", "a", "one"), ("f", "b", "two")], "folder string, name string, text string")
    first = sinks.deposit(texts, None, str(tmp_path / "deposit"))
    changed = texts.withColumn("text", F.when(F.col("name") == "b", "three").otherwise(F.col("text")))
    sinks.deposit(changed, spark.createDataFrame(first.collect(), first.schema), str(tmp_path / "deposit"))
    assert rows_of(sinks.deposited(spark, str(tmp_path / "deposit")), "name", "text") == [("a", "one"), ("b", "three")]
    assert sinks.gold_lines(spark.createDataFrame([("r", 0, 1, "x  y")], "register string, page int, line int, text string")).first()["fingerprint"] == sinks.gold_lines(spark.createDataFrame([("r", 0, 1, "x y")], "register string, page int, line int, text string")).first()["fingerprint"]


def test_trees_grids_and_embeddings(spark, tmp_path):
    from corpuslens.operators import hierarchy

    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", None), ("x", "y"), ("y", "x"), ("z", None)], "node string, parent string")
    counts = spark.createDataFrame([("b", 2), ("c", 5), ("x", 9)], "node string, n long")
    closed = hierarchy.closure(nodes)
    assert [(r["root"], r["nodes"], r["detections"], r["band"]) for r in hierarchy.trees(nodes, closed, counts).collect()] == [("c", 1, 5, "C"), ("a", 2, 2, "C")]
    assert hierarchy.trees(nodes, closed, counts, zero=True).count() == 3
    t = spark.createDataFrame([("1", "A", "d", ["x"], None, 1, False, 0), ("2", "B", "d", ["y"], "1", 0, True, 1)], "id string, name string, description string, sources array<string>, parent string, level int, validated boolean, pos int")
    assert taxonomy.is_tree(t) and not taxonomy.is_tree(t.withColumn("parent", F.lit(None).cast("string"))) and not taxonomy.is_tree(t.unionByName(t.filter("id = '2'").withColumn("parent", F.lit("2"))))
    assert ("several_parents", "2") in {(r["kind"], r["subject"]) for r in taxonomy.violations(t.unionByName(t.filter("id = '2'").withColumn("parent", F.lit("9")))).collect()}
    sinks.write_taxonomy(t, str(tmp_path / "grid"))
    back = files.read_taxonomy(spark, str(tmp_path / "grid"))
    assert back.select(*t.columns).exceptAll(t).isEmpty() and back.count() == 2
    v = topics.embed(spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string"), lambda texts: [[len(t), 4.0 * bool(t)] for t in texts])
    assert {r["id"]: r["vector"] for r in v.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_sql_functions(spark):
    names = sql.register(spark)
    assert spark.sql("select cl_normalise('Été  À') as x, cl_fold('É') as y, cl_category('CC_1') as z").first() == ("ete a", "e", "CC")
    assert [r["kind"] for r in spark.sql("select * from cl_spans('a@b.fr et 06 12 34 56 78')").collect()] == ["email", "telephone"] and "cl_redact" in names


def test_command_line(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(1, "la gare du village est fermée depuis un an", "a"), (2, "la gare du village est fermée depuis un an", "b")], "id long, text string, place string")
    docs.write.parquet(str(tmp_path / "docs"))
    cli.main(["dedup", str(tmp_path / "docs"), str(tmp_path / "groups")], spark)
    assert spark.read.parquet(str(tmp_path / "groups")).count() == 2
    cli.main(["index", str(tmp_path / "docs"), str(tmp_path / "index")], spark)
    for extra in ([], ["--index", str(tmp_path / "index")]):
        cli.main(["search", str(tmp_path / "docs"), "gare", *extra], spark)
        assert "la gare du village" in capsys.readouterr().out
    for command in ("typology", "pii"):
        cli.main([command, str(tmp_path / "docs"), str(tmp_path / command)], spark)
    spark.createDataFrame([("r", "p", 0, "une page", False, False)], "register string, place string, page int, text string, needs_ocr boolean, transcribed boolean").write.parquet(str(tmp_path / "pages"))
    cli.main(["segment", str(tmp_path / "pages"), str(tmp_path / "segments")], spark)
    cli.main(["coverage", str(tmp_path / "pages"), "--json"], spark)
    assert "register" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "segments")).count() == 1


# Text, hierarchies and lexicons
def test_normalise_decomposes_whole_characters(spark):
    import re
    import unicodedata

    def plain(text):
        kept = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return " ".join(re.findall("[a-z0-9]+", kept.lower()))

    texts = ["une ﬁn, l'oﬃce et la ﬂûte", "ᴬ bc ｆｕｌｌ ①②", "½ kilo, ㎏ et ℡", "Ĳsselmeer ŀl Ǆ", "ét᪰e॑", "𝒜𝒷𝟘", "Straße Œuvre ñ Å", "aཱིb", "no. № Ⅷ ™"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalise(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [plain(t) for t in texts]
    assert got[0]["n"] == "une fin l office et la flute" and T.fold_word("ﬁn") == "fin"


def test_closure_of_a_long_chain_and_cycles(spark, monkeypatch):
    from corpuslens.operators import hierarchy

    chain = spark.range(400).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.col("id").cast("string").alias("name"))
    rounds = []
    kept = hierarchy.materialised
    monkeypatch.setattr(hierarchy, "materialised", lambda df: rounds.append(1) or kept(df))
    closed = hierarchy.closure(chain)
    assert closed.count() == 400 * 401 // 2 and closed.filter("distance <> node - ancestor").isEmpty() and len(rounds) <= 20
    assert hierarchy.cycles(chain).count() == 0
    loops = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 4), (7, None), (8, 99)], "node long, parent long")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(1, 9)], "node long, name string")
    assert sorted((r["length"], r["path"]) for r in hierarchy.cycles(loops, names).collect()) == [(1, ["n5", "n5"]), (3, ["n1", "n2", "n3", "n1"])]
    assert rows_of(hierarchy.closure(loops).filter("node = 6")) == [(1, 6, 2), (2, 6, 3), (3, 6, 4), (4, 6, 1), (6, 6, 0)]
    tree = spark.createDataFrame([(1, None, "top"), (2, 1, "mid"), (3, 2, "top"), (4, 3, "leaf")], "node long, parent long, name string")
    got = hierarchy.multi_paths(hierarchy.closure(tree), tree.select("node", "name")).collect()
    assert [(r["node"], r["target"], r["paths"]) for r in got] == [(4, "top", [["leaf", "top"], ["leaf", "top", "mid", "top"]])]


def test_lexicon_in_memory_and_joined(spark):
    from corpuslens.operators import lexicon

    docs = spark.createDataFrame([(1, "Les chevaux galopent, l'été 'aj-v xx"), (2, ""), (3, None), (4, "inconnu inconnu chevaux"), (5, "a bb 12345 ---")], "id long, text string")
    known = spark.range(300_000).select(F.concat(F.lit("mot"), F.col("id").cast("string")).alias("word")).unionByName(spark.createDataFrame([("les",), ("chevaux",), ("galopent",), ("chevaux",), (None,)], "word string"))
    want = {1: (5, 3), 2: (0, 0), 3: (0, 0), 4: (3, 1), 5: (0, 0)}
    for most in (lexicon.LEXICON_WORDS, 1000):
        got = {r["id"]: r for r in lexicon.quality_scores(docs, known, most).collect()}
        assert {i: (r["words"], r["known"]) for i, r in got.items()} == want and got[1]["score"] == 0.6 and got[2]["score"] == 0
    assert rows_of(lexicon.frequent_words(docs, 8)) == rows_of(lexicon.frequent_words(docs, 7)) != []


def test_commands_of_tables(spark, tmp_path):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return str(tmp_path / name)

    docs = table("docs", [(1, "le train passe par la gare"), (2, "une taxe")], "id long, text string")
    (tmp_path / "grid.json").write_text('{"Rail": "gare train", "Fisc": "taxes"}')
    out = lambda name: str(tmp_path / f"out-{name}")
    cli.main(["grid", docs, str(tmp_path / "grid.json"), out("grid")], spark)
    assert rows_of(spark.read.parquet(out("grid")), "topic", "id") == [("Fisc", 2), ("Rail", 1)]
    cli.main(["quality", docs, out("quality"), "--lexicon", table("lexicon", [("train",), ("gare",)], "word string")], spark)
    assert rows_of(spark.read.parquet(out("quality")), "id", "words", "known") == [(1, 4, 2), (2, 2, 0)]
    cli.main(["lots", table("asked", [(1, 6), (2, 6), (3, 1)], "id long, size long"), out("lots"), "--limit", "10"], spark)
    assert rows_of(spark.read.parquet(out("lots")), "id", "lot") == [(1, 0), (2, 1), (3, 1)]
    cli.main(["names", table("asked_names", [("gares",)], "name string"), table("topics", [("gare", 0), ("train", 1)], "name string, pos int"), out("names")], spark)
    assert rows_of(spark.read.parquet(out("names")), "name", "nearest") == [("gares", "gare")]
    cli.main(["fidelity", table("pairs", [(1, "ab", "ac")], "page_id long, reference string, text string"), out("fidelity")], spark)
    assert rows_of(spark.read.parquet(out("fidelity")), "page_id", "cer") == [(1, 0.5)]
    cli.main(["cluster", table("vectors", [(0, i, [float(i // 6 * 9), i % 6 / 50]) for i in range(12)], "level int, id long, vector array<double>"), out("cluster")], spark)
    assert spark.read.parquet(out("cluster")).filter("not noise").select("cluster").distinct().count() == 2
