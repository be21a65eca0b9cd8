"""Operators on small fixtures, against expectations or plain Python."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpuslens import fixed, schemas
from corpuslens.functions import french
from corpuslens.functions import spans as S
from corpuslens.functions import text as T
from corpuslens.operators import components, coverage, duplicates, evaluation, geography, hierarchy, layers, reading, search, segmentation, taxonomy, topics, typology


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("Été à l'ŒUVRE", "ete a l uvre"), ("  ", ""), ("A-b_c 12", "a b c 12")])
def test_normalise(spark, text, want):
    assert one(spark, text, T.normalise) == want


@pytest.mark.parametrize("text,want", [("", []), ("a b", ["a b"]), ("a b c d e", ["a b c d e"]), ("a b c d e f", ["a b c d e", "b c d e f"])])
def test_shingles(spark, text, want):
    assert one(spark, text, T.shingles) == want


def test_clean_and_markdown(spark):
    assert one(spark, "a\r\n  b \t c  \r", T.clean_page) == "a\nb c"
    assert one(spark, "thoughts</think># Title\n**bold** `x` ![i](u)", T.strip_markdown) == "Title\nbold x"


def test_drift_and_comments(spark):
    assert one(spark, "la même ligne\n" * 60, T.is_drift)
    assert not one(spark, " ".join(f"mot{i}" for i in range(150)), T.is_drift)
    assert one(spark, "L'image est vide.", T.is_empty_page_comment)
    assert not one(spark, "vide " * 100 + "page vide", T.is_empty_page_comment)


def test_reading_text_keeps_three_values(spark):
    rows = [(1, "n", None, None), (2, "n", True, None), (3, "n", False, None), (4, "n", True, "t"), (5, "n", None, "page vierge")]
    df = spark.createDataFrame(rows, "i int, n string, f boolean, t string").select("i", reading.reading_text(F.col("n"), F.col("f"), F.col("t")).alias("r"))
    assert {r["i"]: (r["r"]["text"], r["r"]["source"]) for r in df.collect()} == {1: ("n", "native"), 2: (None, None), 3: ("n", "native"), 4: ("t", "transcription"), 5: ("", "transcription")}


LETTER = "Monsieur le Maire,\n" + "Je demande une gare dans notre village parce que les trains ne passent plus du tout ici.\n" + "Veuillez agréer mes salutations\nJean Petit\n"


FILL = "une ligne assez longue pour que le document ait déjà tout le volume qu'il lui faut ici"
REGISTER = [
    ("Le 21 février 2019", "debut"),  # the first line begins the first document whatever it is
    ("Monsieur le Préfet,", None),  # too little volume for the salutation to cut
    (FILL, None),
    ("cordialement", None),
    ("Jean Petit", None),  # four signature lines follow a closing formula
    ("rue", None),
    ("12", None),
    ("Lyon", None),
    ("encore", "cloture"),  # the fifth is another document
    ("-----", None),
    (FILL, None),
    ("-----", "separateur"),
    (FILL, None),
    ("Contribution n° 12", "numerotation"),
    ("veuillez agréer", None),
    (FILL, "cloture"),  # a long line is no signature
    ("salutations", None),
    ("Madame,", "apostrophe"),  # an opening comes before what the closing formula allows
]


def test_segmentation_of_a_register_by_hand(spark):
    text = [line for line, _ in REGISTER]
    want = [(i, s) for i, (_, s) in enumerate(REGISTER) if s]
    for pages in ([text], [text[:5], text[5:6], [], text[6:]], [[line] for line in text]):
        df = spark.createDataFrame([("r", p * 40, "\n".join(x)) for p, x in enumerate(pages)] + [("other", 0, "a"), ("blank", 0, " \n"), (None, 1, "x")], "register string, page int, text string")
        for fan in (256, 2):
            rows = segmentation.segment(df, fan=fan).filter("register = 'r'").orderBy("position").collect()
            assert [(r["first_line"], r["signal"]) for r in rows] == want
            assert "\n".join(r["text"] for r in rows).split("\n") == text and sum(r["n_lines"] for r in rows) == len(text)
            assert [r["position"] for r in rows] == list(range(len(want))) and rows[0]["start_page"] == 0


def test_segmentation_does_not_depend_on_blocks(spark):
    """A long register is the same as one block of pages and as many, with tables in several levels."""
    rng = random.Random(1)
    parts = ["Monsieur le Préfet,", "Le 21 février 2019", "-----", "Contribution n° 12", "cordialement", "Jean", "x" * 70, FILL, "1. puce"]
    lines = [rng.choice(parts) for _ in range(4000)]
    by = lambda step: spark.createDataFrame([("r", i, "\n".join(lines[i * step : (i + 1) * step])) for i in range(-(-len(lines) // step))], "register string, page int, text string")
    of = lambda df, fan: [(r["first_line"], r["signal"], r["text"]) for r in segmentation.segment(df, fan=fan).orderBy("position").collect()]
    whole = of(by(4000), 256)
    assert len(whole) > 400 and of(by(3), 3) == whole
    assert segmentation.boundaries(segmentation.segment(by(3), fan=4)).count() == len(whole)


def test_typology_order(spark):
    rows = [(1, LETTER, False), (2, LETTER, True), (3, "Nous soussignés demandons cela.", False), (4, "é1 2 3 4 5 6 7 8 9 10 11 12 13", False), (5, "", False), (6, "Je suis retraité et ma retraite baisse.", False)]
    got = {(r["id"], r["axis"]): (r["value"], r["detector"]) for r in typology.classify(spark.createDataFrame(rows, "id int, text string, recopied boolean")).collect()}
    assert got[1, "support"] == ("courrier", "appel+politesse")
    assert got[2, "support"] == ("lettre_type", "doublon_multi_communes")
    assert got[3, "support"][0] == "petition" and got[3, "auteur"] == ("collectif", "soussignes_pluriel")
    assert got[4, "support"][0] == "illisible" and got[5, "support"] == ("registre", "defaut")
    assert got[6, "auteur"] == ("individu", "premiere_personne+situation_personnelle")


def test_pii_spans_merge_and_render(spark):
    text = "Ecrire à jean@x.fr ou 06 12 34 56 78, mairie@ville.fr, 12 rue des Lilas où habite M. Dupont.\nMonsieur le Maire\nPaul Durand"
    spans = S.detect(text)
    kinds = [(text[a:b], k) for a, b, k, _ in spans]
    assert ("jean@x.fr", "email") in kinds and ("06 12 34 56 78", "telephone") in kinds and ("mairie@ville.fr", "institution") in kinds
    assert ("12 rue des Lilas", "adresse") in kinds and ("Paul Durand", "nom") in kinds
    assert any(k == "role_public" for _, k in kinds)
    def render(text, spans):
        return spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int,kind:string,confirmed:boolean>>").select(S.redacted("t", "s").alias("x")).first()["x"]

    shown = render(text, [(a, b, k, None if k != "email" else False) for a, b, k, _ in spans])
    assert "jean@x.fr" in shown and "[téléphone]" in shown and "mairie@ville.fr" in shown and "[nom]" in shown
    assert render("abcd", [(0, 2, "nom", None), (2, 4, "email", True)]) == "[nom]"
    assert render("aé𝒳d ef", [(5, 6, "email", True), (1, 3, "nom", None), (2, 3, "url", None)]) == "a[nom]d [courriel]f"
    assert render("abc", [(0, 1, "lieu", None), (1, 2, "nom", False)]) == render("abc", None) == "abc" and render(None, []) is None
    df = spark.createDataFrame([(text,), (None,)], "t string").select(S.pii_spans("t").alias("s")).collect()
    assert len(df[0]["s"]) == len(spans) and df[1]["s"] == []


def plain_excerpt(text, words, width=260):
    """The excerpt in plain Python, on texts whose folding keeps every character's place."""
    import re

    own = " ".join(text.split())
    if len(own) <= width:
        return own
    folded, places = "".join(T.fold_word(c) for c in own), []
    for w in words:
        for n in range(len(w), 3, -1):
            if m := re.search(r"\b" + w[:n], folded):
                places.append(m.start())
                break
    at = min(places, default=0)
    blanks = [-1, *[i for i, c in enumerate(own) if c == " "], len(own)]
    low = max(0, at - width // 3)
    word = max(i for i in blanks if i < low or i == -1) + 1
    start = word if low - word <= 40 else low
    aim = min(len(own), max(start, at - width // 3) + width)
    stop = min(i for i in blanks if i >= aim)
    end = stop if stop - aim <= 40 else aim
    return "… " * (start > 0) + own[start:end] + " …" * (end < len(own))


def test_excerpts_against_plain_python(spark):
    rng = random.Random(5)
    vocabulary = ["impôts", "Impôt", "gare", "été", "a", "taxation", "x" * 90, "train,", "école.", "le"]
    texts = [" \n".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 160))) for _ in range(150)] + ["mot " * 200 + "impôts locaux " + "fin " * 200, "y" * 600]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for query in ('"impôt" -gare ou', "gare train", "rien", "taxations é"):
        words = search.Query(query).words
        got = [r["x"] for r in df.select(T.excerpt(F.col("t"), words).alias("x")).collect()]
        assert got == [plain_excerpt(t, words) for t in texts] + [""], query
    assert search.Query('"Impôts locaux" ou été -taxe impots 12').words == ["impots", "locaux", "ete"]


def test_chunks_and_wer(spark):
    def cut(text, limit):
        return spark.createDataFrame([(text,)], "t string").select(S.chunks(F.col("t"), limit).alias("c")).first()["c"]

    assert cut("", 5) == cut(None, 5) == [""] and cut("a b c\nd e\nf", 3) == ["a b c", "d e\nf"]
    assert cut(" a\u00a0b  c d e f g\n\n h\ni", 3) == ["a b c", "d e f", "g\nh\ni"]
    assert S.word_error_rate("a b c", "a x c d") == pytest.approx(2 / 3) and S.word_error_rate("", "") == 0 and S.word_error_rate("", "a") == 1


def plain_rank(tokens, demands):
    """Cover density by trying every stretch: those that meet all demands and hold no shorter one."""
    at = [(i, {k for k, ws in enumerate(demands) if w in ws}) for i, w in enumerate(tokens)]
    at = [(i, ks) for i, ks in at if ks]
    full = [(x, y) for x in range(len(at)) for y in range(x, len(at)) if set().union(*[ks for _, ks in at[x : y + 1]]) == set(range(len(demands)))]
    least = [(x, y) for x, y in full if not any((u, v) != (x, y) and x <= u and v <= y for u, v in full)]
    return sum(0.1 / (1 + at[y][0] - at[x][0] - (y - x)) for x, y in least)


def test_french_forms_share_a_stem():
    same = [("chevaux", "cheval"), ("nationaux", "national"), ("finissait", "finir"), ("continuellement", "continuel"), ("majestueusement", "majestueux"), ("impots", "impot"), ("mangeait", "manger"), ("contradictions", "contradiction")]
    assert all(french.stem(a) == french.stem(b) for a, b in same)
    stems = "continuation continu continuerait continu continuons continuon contradictoirement contradictoir contractait contract majordome majordom maintenait mainten maitresse maitress mairie mair quand quand".split()
    assert [french.stem(w) for w in stems[::2]] == stems[1::2]
    assert french.stem("") == "" and french.stem("a") == "a" and search.stem("dans") is None


def test_forms_stop_words_and_gaps_are_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Les chevaux de la commune"), (2, "un cheval"), (3, "le pouvoir d'achat baisse"), (4, "pouvoir achat"), (5, "pouvoir cher achat"), (6, "ligature: une ﬁn nationale")], "id long, text string")
    search.write_index(docs, str(tmp_path / "i"))
    for query, want in (("cheval", {1, 2}), ("les cheval", {1, 2}), ("chevaux -communes", {2}), ('"pouvoir d\'achat"', {3, 5}), ('"pouvoir achat"', {4}), ("fin nationaux", {6}), ("les", set())):
        direct = {r["id"] for r in search.search(docs, query).collect()}
        assert direct == want, query
        if want:
            assert {r["id"] for r in search.find(spark, str(tmp_path / "i"), query).collect()} == want, query
    with pytest.raises(ValueError):
        search.find(spark, str(tmp_path / "i"), "les")


def test_top_reads_few_ranges(spark, tmp_path):
    """The best are those of the full ranking, from the ranges of long documents only."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["gare", "train", "maire", "pont", "route"]) for _ in range(4 + i % 12))) for i in range(600)]
    rows += [(1000 + i, " ".join(rng.choice(["gare", "train", "pont"]) for _ in range(300))) for i in range(40)]
    search.write_index(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "i"), range_docs=20)
    for query, limit in (("gare", 5), ("gare train", 10), ('"gare pont" ou route train', 3), ("maire", 30)):
        full = sorted(((r["id"], r["rank"]) for r in search.find(spark, str(tmp_path / "i"), query).collect()), key=lambda x: (-x[1], x[0]))
        best, read, total = search.top(spark, str(tmp_path / "i"), query, limit)
        assert best == full[:limit], query
        assert total > 20 and (read <= 6 or query == "maire")


def test_rank_and_index(spark, tmp_path):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["gare", "train", "trains", "impot", "maire", "et", "x"]) for _ in range(rng.randint(0, 25))) for i in range(80)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(900, None)], "id long, text string")
    search.write_index(docs, str(tmp_path / "index"))
    for query, demands in (("gare", [{"gare"}]), ("gare train", [{"gare"}, {"train"}]), ("gare ou train impot", [{"gare", "train"}, {"impot"}]), ('"gare train" -"maire maire"', [{"gare"}, {"train"}])):
        direct = {r["id"]: r for r in search.search(docs, query, limit=100).collect()}
        found = {r["id"]: r for r in search.search_index(docs, str(tmp_path / "index"), query, limit=100).collect()}
        assert {i: (round(r["rank"], 9), r["snippet"]) for i, r in direct.items()} == {i: (round(r["rank"], 9), r["snippet"]) for i, r in found.items()} and direct
        for i, r in found.items():
            tokens = [search.stem(w) for w in texts[i].split()]
            assert r["rank"] == pytest.approx(plain_rank(tokens, [{search.stem(w) for w in d} for d in demands])), (query, texts[i])
        if query.startswith('"'):
            assert set(found) == {i for i, t in texts.items() if " gare train " in f" {t.replace('trains', 'train')} " and " maire maire " not in f" {t} "}
    with pytest.raises(ValueError):
        search.find(spark, str(tmp_path / "index"), "-gare")


def test_candidates_of_large_bands_are_complete(spark):
    """More documents than a small band holds, of every similarity around the threshold."""
    rng, rows = random.Random(4), []
    base = [f"w{i}" for i in range(80)]
    for k in range(120):
        own = list(base)
        for j in rng.sample(range(16), rng.randint(0, 3)):
            own[j * 5] = f"own{k}x{j}"
        rows.append((k, " ".join(own), "p"))
    docs = spark.createDataFrame(rows, "id long, text string, place string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(76)} for i, t, _ in rows}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    want = {(a, b) for a, b in near if first[frozenset(sets[a])] == a and (first[frozenset(sets[b])] == b or first[frozenset(sets[b])] == a)}
    got = {(r["a"], r["b"]) for r in duplicates.similar_pairs(docs).collect()}
    assert got == want and len(want) > 100
    assert {(r["a"], r["b"]) for r in duplicates.similar_pairs(docs, exact=True).collect()} == want
    assert {r["id"]: r["earliest"] for r in duplicates.earliest(docs).collect()} == {b: min(a for a, x in near if x == b) for _, b in near}


def test_duplicates_and_components(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "a"), (2, base, "b"), (3, base + " tail", None), (4, "something else entirely here now", "a"), (5, "", "a")]
    got = duplicates.groups(spark.createDataFrame(rows, "id long, text string, place string")).collect()
    assert {r["id"] for r in got} == {1, 2, 3} and {r["group_id"] for r in got} == {1} and got[0]["places"] == 2 and got[0]["size"] == 3
    with pytest.raises(ValueError):
        duplicates.similar_pairs(spark.createDataFrame(rows, "id long, text string, place string"), 0.4)
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}


def test_search_syntax(spark):
    docs = spark.createDataFrame([(1, "Les impôts locaux augmentent"), (2, "La taxe et l'impôt"), (3, "rien")], "id int, text string")
    ids = lambda q: sorted(r["id"] for r in search.search(docs, q).collect())
    assert ids("impot") == [1, 2] and ids("impôt -taxe") == [1] and ids('"impôts locaux"') == [1] and ids("taxe ou rien") == [2, 3] and ids('"rien') == [3]
    with pytest.raises(ValueError):
        search.Query("  ")
    grid = {(r["topic"], r["id"]): r["summary"] for r in search.keyword_grid(docs, {"fisc": "impôt", "x": "taxe"}).collect()}
    assert set(grid) == {("fisc", 1), ("fisc", 2), ("x", 2)} and grid["fisc", 1] == "mots-clés : impot"


def test_hierarchy_with_cycle(spark):
    rows = [("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "X"), ("z", "x", "Z"), ("q", "gone", "Q")]
    nodes = spark.createDataFrame(rows, "node string, parent string, name string")
    s = hierarchy.statistics(nodes).first()
    assert (s["nodes"], s["roots"], s["isolated"], s["cyclic"], s["max_depth"], s["max_children"], s["repeated_names"]) == (7, 2, 1, 3, 3, 2, 1)
    closed = hierarchy.closure(nodes)
    assert {r["node"]: r["path"] for r in hierarchy.paths(closed, nodes.select("node", "name")).collect()}["c"] == "A > B > C"
    assert hierarchy.skeleton(nodes, closed, hierarchy.roll_up(closed, spark.createDataFrame([("c", 3)], "node string, n long")), 1).count() > 0


def test_taxonomy(spark):
    rows = [("1", "Gare", "d", ["x"], None, 0, False, 0), ("2", "Gare", "d", ["y", "x"], "9", 1, False, 1), ("3", "Train", "d", ["x"], "1", 0, False, 2), ("4", " ", "d", [], None, 0, False, 3), ("5", "Vide", "d", [], None, 2, False, 4), ("6", "Soi", "d", [], "6", 0, False, 5), ("9", "Haut", "", [], None, 2, True, 6)]
    t = spark.createDataFrame(rows, "id string, name string, description string, sources array<string>, parent string, level int, validated boolean, pos int")
    out = {r["id"]: r for r in taxonomy.sanitise(t).collect()}
    assert set(out) == {"2", "3", "6", "9"} and out["3"]["parent"] == "2" and out["6"]["parent"] is None and out["2"]["sources"] == ["x", "y"]
    bad = {(r["kind"], r["subject"]) for r in taxonomy.violations(t).collect()}
    assert bad == {("duplicate_name", "Gare"), ("self_parent", "6"), ("empty_field", "4"), ("empty_field", "9")}
    assert taxonomy.insert_parents(t, spark.createDataFrame([("n", "Neu", "d", "3")], "id string, name string, description string, child string")).filter("id = 'n'").first()["level"] == 1
    assert taxonomy.graph_elements(t).filter("kind = 'edge'").count() == 3


def test_geography(spark):
    assert one(spark, "CC_01200_190411_2B077_XY_77.pdf", geography.code_of_file) == "2B077" and one(spark, "CC_01200_190411_00000_XY_1.pdf", geography.code_of_file) is None
    assert [one(spark, c, geography.department) for c in ("97411", "2A004", "01053", "00000")] == ["974", "2A", "01", None]
    names = spark.createDataFrame([("PRE LA FORET",), ("PRÉ-LA-FORÊT",), (" ",)], "name string")
    assert geography.spellings(names).first()["shown"] == "PRÉ-LA-FORÊT"
    places = spark.createDataFrame([("1", "COM", None), ("2", "COMD", "1"), ("3", "COM", None), ("4", "COM", None)], "code string, kind string, parent_code string")
    moves = spark.createDataFrame([("3", "5", "2021"), ("3", "6", "2020"), ("6", "7", "2022"), ("4", "8", "2020"), ("8", "4", "2021")], "from_code string, to_code string, date string")
    got = {r["code"]: r["current"] for r in geography.current_codes(places, moves, spark.createDataFrame([("1",), ("7",)], "code string")).collect()}
    assert got == {"1": "1", "2": "1", "3": "7", "4": None}
    features = spark.createDataFrame([("01", "Polygon", "[[[1.0,2.0],[3.0,4.0]],[[9.0,9.0]]]"), ("02", "MultiPolygon", "[[[[5.0,6.0]]],[[[7.0,8.0]]]]")], "code string, type string, coordinates string")
    rings = {r["code"]: r["rings"] for r in geography.outlines(features).collect()}
    assert rings["01"] == [[Row(lat=2.0, lon=1.0), Row(lat=4.0, lon=3.0)]] and len(rings["02"]) == 2


def test_coverage_bins_and_classes(spark):
    h = coverage.histogram(spark.createDataFrame([(0.3,), (1.0,), (None,)], "s double"), "s").collect()
    assert {r["bin"]: r["n"] for r in h} == {i: int(i in (2, 9)) for i in range(10)}
    rows = [("p", None, None, False, False), ("p", True, None, False, False), ("p", True, "t", False, False), ("p", True, "x", True, False), ("p", True, "y", False, True)]
    c = coverage.page_classes(spark.createDataFrame(rows, "place string, needs_ocr boolean, transcription string, is_empty boolean, is_drift boolean"), "place").first()
    assert (c["native"], c["unprocessed"], c["transcribed"], c["empty"], c["drift"]) == (1, 1, 1, 1, 1) and c["usable_rate"] == 0.4


def test_evaluation_edges(spark):
    rows = [("a", [0, 5], [0, 5], 10), ("b", [0], [0], 1), ("c", [0, 5], [0, 6, 8], 10)]
    got = {r["register"]: r for r in evaluation.boundary_scores(spark.createDataFrame(rows, "register string, expected array<int>, found array<int>, n_lines int")).collect()}
    assert got["a"]["window_diff"] == 0 and got["a"]["hits"] == 1 and got["b"]["window_diff"] == 0 and got["c"]["window_diff"] > 0


def test_layers(spark, tmp_path):
    runs = spark.createDataFrame([], schemas.RUN)
    runs, a = layers.create_run(runs, "doublons", "one", "me", activate=True)
    runs, b = layers.create_run(runs, "doublons", "two", "me", activate=True)
    assert layers.active_run(runs, "doublons") == b != a and layers.active_run(runs, "typologie") is None
    with pytest.raises(ValueError):
        layers.create_run(runs, "nothing", "x", "me")
    rows = spark.createDataFrame([(1, "x")], "id long, v string")
    for run in (1, 2, 1):
        layers.write_layer(rows, str(tmp_path / "layer"), run)
    layer = spark.read.parquet(str(tmp_path / "layer"))
    assert layer.count() == 2 and layers.served(layer, None).count() == 0 and layers.served(layer, 2).count() == 1
    assert layers.author("  someone ") == "someone" and layers.author(" ")
    layers.check_kind(runs, a, "doublons")
    with pytest.raises(ValueError):
        layers.check_kind(runs, a, "typologie")
    again, new = layers.reopen_run(runs, "analyse", "grid:x", "grid", "me", corpus="c1")
    same, found = layers.reopen_run(again, "analyse", "grid:x", "grid", "me", corpus="c2")
    assert new == found and same.filter(F.col("id") == new).first()["corpus"] == "c2" and same.count() == again.count() == 3
    with pytest.raises(ValueError):
        layers.check_grid({"grille": "g", "source": "s", "topics": [{"id": 1, "parent": 2}]})


def test_resolve_and_instances(spark):
    got = layers.resolve_documents(spark.createDataFrame([("42",), ("d7",), ("d9",)], "external_doc_id string"), spark.createDataFrame([(42,)], "id long"), spark.createDataFrame([(7, 42)], "id long, contribution_id long")).orderBy("external_doc_id").collect()
    assert [(r["document_id"], r["contribution_id"]) for r in got] == [(None, 42), (7, 42), (None, None)]


def test_streams(spark, tmp_path):
    from corpuslens.streaming import ingest

    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, k long")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.run_pass(ingest.stream_table(spark, str(tmp_path / "in"), rows.schema, 1), "id", lambda b: b.filter("k = 1"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_files(spark, tmp_path):
    from corpuslens.sources import files, sinks

    for name in ("CC_10.pdf", "CC_9.pdf", "XX_1.pdf", "A_lire/CC_3.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"one\ftwo")
    found = files.list_files(spark, str(tmp_path)).orderBy("order").collect()
    assert [r["name"] for r in found] == ["CC_9.pdf", "CC_10.pdf"]
    pages = files.read_pages(spark, str(tmp_path), lambda path, content: enumerate(content.decode().split("\f")))
    assert pages.count() == 8
    sinks.write_dataset(spark.createDataFrame([(1, 'a "b"\nc')], "id long, text string"), str(tmp_path / "csv"))
    assert files.read_dataset(spark, str(tmp_path / "csv")).first()["content"] == 'a "b"\nc'


def test_all_passes(spark, tmp_path):
    from corpuslens.plans import passes

    pages = spark.createDataFrame([("r1", 0, LETTER + LETTER), ("r2", 0, LETTER)], "register string, page int, text string")
    out = passes.all_passes(pages, spark.createDataFrame([("r1", "A"), ("r2", "B")], "register string, place string"), str(tmp_path), {"segmentation": 1, "doublons": 2, "typologie": 3, "anonymisation": 4})
    assert out["segmentation"].count() == 3 and out["doublons"].first()["places"] == 2
    assert out["typologie"].filter("axis = 'support' and value = 'lettre_type'").count() >= 2


def test_topics_small(spark):
    d = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("b", 2, 1)], "topic string, doc long, n long")
    rows = {r["topic"]: r for r in topics.distribution(d, 4).collect()}
    assert rows["a"]["dominant"] == 1 and rows[fixed.OUTSIDE]["documents"] == 2
    assert topics.nearest_name(spark.createDataFrame([("gares",)], "name string"), spark.createDataFrame([("train", 0), ("gare", 1)], "name string, pos int")).first()["nearest"] == "gare"


def test_wer_pairs_reads_whole_turns(spark, tmp_path):
    from corpuslens.queries import QUERIES

    words = " ".join(["word"] * 99)
    spark.createDataFrame([(1, 0, f"{words} end"), (1, 1, f"{words} other")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["wer"] for r in QUERIES["wer_pairs"](spark, str(tmp_path)).collect()] == [0.01]


def test_taxonomy_sanitise_reads_all_parts(spark, tmp_path):
    from corpuslens.queries import QUERIES

    spark.range(390, 431).select(F.col("id").alias("p_partkey"), F.concat(F.lit("TYPE "), "id").alias("p_type")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert "420" in {r["id"] for r in QUERIES["taxonomy_sanitise"](spark, str(tmp_path)).collect()}
