"""The training-data operators against brute force, round trips and held-out labels, and on
messy tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import _tokens, decontaminate, graph, near_dedup, neighbours, packing, passages, pii, quality, sharding, toxicity, warc
from corpuslens.llm.queries import tokenizer_path

CLASHES = "row long, id long, size long, key string, spans string, weight double, score double, pid long, chunk int, shard int, band long, node long, base string, n_words long, loss double, h1 string"
MESSY = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES
EXTRA = (1, 2, 3, "k", "s", 0.5, 0.5, 4, 5, 6, 7, 8, "b", 9, 0.1, "h")
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(1, "Some plain text with a few words in it.", "en"), (2, None, "en"), (3, "", None), (None, "no id here but text", "fr"), (4, "Some plain text with a few words in it.", "en"), (4, "Some plain text with a few words in it.", "en"), (5, " \n\t ", "de"), (6, LONG, "en"), (7, "é" * 300, None), (8, "...!!!", "es"), (9, "one", "en"), (10, "x@y.org " * 50, "en")]
    return spark.createDataFrame([(i, t, lang, "s", 1, *EXTRA) for i, t, lang in rows], MESSY)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], MESSY)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (10, 1, 0)], "doc_id long, quality int, toxic int")


BENCH = [(1, "a few words"), (None, "text"), (2, None), (3, "")]
OPERATORS = {
    "toxicity": lambda docs, labels, bench: toxicity.score_toxicity(docs, labels),
    "near_dedup": lambda docs, labels, bench: near_dedup.near_duplicates(docs),
    "passages": lambda docs, labels, bench: passages.remove_passages(docs),
    "quality": lambda docs, labels, bench: quality.classify(docs, labels),
    "sharding": lambda docs, labels, bench: sharding.shard_by_bytes(docs),
    "decontamination": lambda docs, labels, bench: decontaminate.contamination_report(docs, bench),
    "pii": lambda docs, labels, bench: pii.pii_report(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_and_empty_tables(name, spark, messy, nothing, labels):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert OPERATORS[name](messy, labels, bench).count() == messy.count()
    assert OPERATORS[name](nothing, labels, bench).count() == 0


def test_packing_nothing_and_no_labels(spark, messy, nothing, labels):
    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0
    assert quality.classify(messy, labels.limit(0)).filter("keep").count() == messy.count()
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(messy, labels.limit(0)).collect())


# 1 toxicity
def test_grammar_scores_clauses_not_words():
    m = toxicity.grammar()
    plain, near, negated, reported = m.weigh("oo5oo"), m.weigh("ot5oo"), m.weigh("no5oo"), m.weigh("r5ooo")
    assert near > plain > reported > negated > 0
    assert m.weigh("5t") == near and m.weigh("wkt") > 2 and m.weigh("kt") == 0 and m.weigh("nwkt") == m.weigh("wnkt") == 0 and m.weigh("nooowkt") > 2
    assert m.weigh("ooo") == 0 and m.weigh("55") < 2 * m.weigh("5")


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    marks = ["zworgu", "zworgal", "zworgite", "quaxon", "quaxel"]
    rows, truth = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = int(i % 8 == 0)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(marks))
        rows.append((i, " ".join(text)))
        truth.append((i, toxic))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(truth, "doc_id long, toxic int")).collect()}
    held = [(got[i]["predicted"], t) for i, t in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in truth)
    assert sum(p == t for p, t in held) / len(held) > 0.95 and sum(p for p, t in held if t) >= 0.8 * sum(t for _, t in held)


# 2 near-duplicates
def test_near_duplicates_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rng = random.Random(2)
    base = [f"hot{i}" for i in range(120)]
    hot = []
    for k in range(60):
        own = list(base)
        own[rng.randrange(120)] = f"changed{k}"
        hot.append((10_000 + k, " ".join(own)))
    docs = docs.unionByName(spark.createDataFrame(hot, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", r["text"].lower())
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids, missed, links = sorted(sets), 0, 0
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            union = len(sets[a] | sets[b])
            if union and len(sets[a] & sets[b]) / union >= 0.84:
                links += 1
                missed += got[a]["class_id"] != got[b]["class_id"]
    assert links > 500 and missed == 0
    for r in got.values():
        assert r["class_id"] <= r["doc_id"] and r["stays"] == (r["class_id"] == r["doc_id"])
    apart = [i for i in ids if i < 10_000 and got[i]["class_id"] != i]
    assert all(len(sets[i] & sets[got[i]["class_id"]]) / len(sets[i] | sets[got[i]["class_id"]]) > 0.5 for i in apart)


def test_near_duplicates_among_a_shared_boilerplate(spark):
    """Bare copies of a boilerplate are linked, though all their bands are those of unlike texts."""
    boilerplate = " ".join(f"plate{i}" for i in range(400))
    rows = [(i, boilerplate + " " + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(600)]
    rows += [(1000 + i, boilerplate + " " + " ".join(f"bare{i}x{j}" for j in range(16))) for i in range(8)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert all(got[1000 + i] == 1000 for i in range(8)) and all(got[i] == i for i in range(600))


def test_consistent_samples_estimate_weighted_jaccard():
    s, rng = near_dedup.Sampler(), np.random.default_rng(5)
    h = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    h.sort()
    w = rng.random(400) * 3 + 0.1
    v = w.copy()
    v[::7] *= 0.4
    x, _ = s.samples(h, np.zeros(400, np.int64), w, 1)
    y, _ = s.samples(h, np.zeros(400, np.int64), v, 1)
    true = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    assert abs((x == y).mean() - true) < 0.2 and (s.samples(h, np.zeros(400, np.int64), w, 1)[0] == x).all()


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_by_stars_and_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(101, 100), (101, 101), (100, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in graph.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert graph.components(edges.limit(0)).count() == 0
    rng = random.Random(3)
    roots = spark.createDataFrame([(n, n // 8 * 8) for n in range(400)], "node long, root long")
    links = [tuple(rng.sample(range(400), 2)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in near_dedup._united(roots, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[a] == got[b] for a, b in links) and all(got[n] <= n // 8 * 8 for n in got) and len(set(got.values())) < 50


# 3 passages
def removed(texts: dict[int, bytes], n: int = 50):
    seen, out = {}, {}
    for i in sorted(texts):
        b, cover = texts[i], bytearray(len(texts[i]))
        for p in range(len(b) - n + 1):
            if seen.setdefault(b[p : p + n], i) < i:
                cover[p : p + n] = b"\x01" * n
        out[i] = (len(b), sum(cover), sum(1 for x in bytes(cover).split(b"\0") if x), hashlib.sha256(bytes(c for c, k in zip(b, cover) if not k)).hexdigest())
    return out


def test_passages_against_brute_force(spark):
    rng = random.Random(9)
    shared = ["".join(rng.choice("abc é") for _ in range(rng.randint(40, 90))) for _ in range(6)]
    texts = {i: "".join(rng.choice([rng.choice(shared), "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 9))) for i in range(80)}
    texts |= {90: "a" * 700, 91: "a" * 300, 92: "", 93: LONG, 94: LONG[100_000:250_000] + "tail"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = removed({i: t.encode() for i, t in texts.items()})
    for chunk in (2000, 1 << 22):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in passages.remove_passages(df, chunk_bytes=chunk, shard_names=5000).collect()}
        assert got == want


def test_passages_of_negative_and_extreme_ids(spark):
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(300))
    ids = [-5, 3, -1, -(1 << 63), (1 << 63) - 2, 0, 1 << 40, None]
    texts = [shared[k * 9 : k * 9 + 90 + 11 * k] + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 70))) + shared[:77] for k in range(len(ids))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    want = removed({(1 << 64) if i is None else i: t.encode() for i, t in zip(ids, texts)})
    for chunk in (200, 1 << 22):
        got = {(1 << 64) if r["doc_id"] is None else r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in passages.remove_passages(df, chunk_bytes=chunk, shard_names=50).collect()}
        assert got == want


# 4 quality
def plain_kneser_ney(texts: list[bytes], order: int = 5):
    """log2-free textbook form: dictionaries of byte strings, one probability at a time."""
    grams = {m: {} for m in range(1, order + 1)}
    for t in texts:
        t = b"\x02" * (order - 1) + t
        for i in range(order - 1, len(t)):
            g = t[i - order + 1 : i + 1]
            grams[order][g] = grams[order].get(g, 0) + 1
    for m in range(order - 1, 0, -1):
        for g in grams[m + 1]:
            grams[m][g[1:]] = grams[m].get(g[1:], 0) + 1
    cuts, contexts = {}, {m: {} for m in grams}
    for m, own in grams.items():
        n1, n2, n3, n4 = (sum(c == k for c in own.values()) for k in (1, 2, 3, 4))
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
            cuts[m] = [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]
        else:
            cuts[m] = [0.5, 0.75, 0.9]
        for g, c in own.items():
            total, left = contexts[m].get(g[:-1], (0, 0.0))
            contexts[m][g[:-1]] = total + c, left + cuts[m][min(c, 3) - 1]

    def p(g: bytes) -> float:
        m = len(g)
        if not m:
            return 1 / 256
        total, left = contexts[m].get(g[:-1], (0, 0.0))
        if not total:
            return p(g[1:])
        c = grams[m].get(g, 0)
        return max(c - cuts[m][min(c, 3) - 1], 0.0) / total * (c > 0) + left / total * p(g[1:])

    return p


def test_perplexities_against_plain_kneser_ney(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect() if len(r["text"] or "") < 3000][:120]
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in rows] + [(-5, None, ""), (None, "en", "no id"), (-6, "en", None), (-7, "xx", "zzzz \x02\x02 é")]
    trusted = [i for i, _, _ in rows if i is not None and i % 3 == 0 and i >= 0]
    p, want = plain_kneser_ney([t.encode() for i, _, t in rows if i in trusted]), {}
    for i, _, t in rows:
        raw = b"\x02" * 4 + (t or "").encode()
        want[i] = (len(raw) - 4, -sum(np.log(p(raw[k - 4 : k + 1])) for k in range(4, len(raw))))
    docs, ids = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2), spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    for chunk in (5000, 1 << 22):
        got = {r["doc_id"]: (r["size"], r["loss"]) for r in quality.perplexities(docs, ids, chunk).collect()}
        assert got.keys() == want.keys()
        assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) <= 1e-3 * want[i][1] + 1e-3 * want[i][0] for i in want), [(i, got[i], want[i]) for i in want][:5]
    assert quality.perplexities(docs, ids.limit(0)) is None


def test_quality_keeps_the_good_and_drops_the_bad(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in got}
    good, bad = ([got[i] for i, q in truth.items() if q == k] for k in (1, 0))
    assert len(got) == docs.count() and sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


# 5 sharding
def test_shards_are_even_whole_and_gapless(spark):
    rng = random.Random(6)
    rows = [(i, "g" * (200 + i % 3) if i % 3 == 0 else "t" * rng.randint(0, 900) + str(i)) for i in range(3000)] + [(None, None), (5, "")]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=5000).collect()
    assert len(got) == len(rows)
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots) and max(sizes) - min(sizes) <= 2 * 905
    text = dict(rows[:3000])
    for r in got[:]:
        if r["doc_id"] in text and r["size"] > 1:
            assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]].encode()))
    assert sorted((r["size"], r["text_crc32"]) for r in got if r["size"] == 1) == [(1, 0), (1, 0)]
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    # A group of equal texts is whole where its shard has room; a third of all rows is not.
    groups = {}
    for r in got:
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(x) == 1 for c, x in groups.items() if c not in {zlib.crc32(b"g" * n) for n in (200, 201, 202)})


def test_overfull_ranges_are_subdivided(spark):
    """Also from splitters that fit the keys badly, and however often it takes."""
    rows = [(i, f"text {i} " + "w" * (i % 50)) for i in range(4000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), sample_keys=1, range_bytes=1000).collect()
    sizes = np.bincount([r["shard"] for r in got], weights=[r["size"] for r in got])
    assert len(got) == 4000 and max(sizes) - min(sizes) <= 2 * 70 and len(sizes) == 8


# 6 packing
def test_packing_round_trip(spark, messy):
    import array

    from tokenizers import Tokenizer

    got = packing.pack_documents(messy, tokenizer_path()).collect()
    t, want = Tokenizer.from_file(tokenizer_path()), []
    for r in messy.select("doc_id", "text").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(array.array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    fill = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_ids_equal_the_tokenizers(spark):
    import pyarrow as pa

    ids, rng = _tokens.Ids(tokenizer_path()), random.Random(8)
    texts = ["a  b\n\n c\t", "x² y Ⅷ 1٣", "it's we'll 'twas ''s !'s 's'll", "'", "x'", "\n's 's", None, "<|endoftext|> a", "é́ ñ_a__b !!  ", "\x85 a b", "😀 a", "日本 語1", "\x1c\x1d a", " ", ""]
    texts += ["".join(rng.choice("abé'sß 12\n\t.,_-! ê²") for _ in range(60)) for _ in range(400)]
    for x, got in zip(texts, ids.batch(pa.array(texts)), strict=True):
        assert got.tolist() == ids.whole.encode(x or "", add_special_tokens=False).ids, x


def test_piece_numbers_fit_any_number_of_partitions():
    import pyarrow as pa

    task = (1 << 30) - 1
    rows = pa.RecordBatch.from_arrays([pa.array([task << 33, (task << 33) + 1]), pa.array([1, 2]), pa.array(["a b c " * 2000, "x"])], names=["row", "doc_id", "text"])
    (out,) = packing.cut_pieces(iter([rows]), tokenizer_path(), 100, 0)
    assert out.column("pid").to_pylist() == [(task << 33) + i for i in range(out.num_rows)] and out.num_rows > 60


def test_genetic_packing_beats_best_fit():
    """Triplets that fill a sequence exactly, which best-fit in decreasing order takes apart."""
    for seed in range(3):
        rng, lengths = random.Random(seed), []
        for _ in range(100):
            a, b = rng.randint(600, 800), rng.randint(500, 700)
            lengths += [a, b, 2048 - a - b]
        greedy = packing.best_fit(sorted(range(300), key=lambda i: -lengths[i]), lengths, 2048)
        bins = packing.evolve(seed, lengths, 2048, [])
        assert np.bincount(bins, weights=lengths).max() <= 2048 and max(bins) + 1 < len(greedy.bins) - 2
        again = packing.evolve(seed + 1, lengths, 2048, [bins])
        assert max(again) <= max(bins)


# 7 neighbours
@pytest.mark.parametrize(("n", "spread", "leaf"), [(2000, 0.3, 300), (9000, 0.3, 700), (3000, 3.0, 400)])
def test_neighbours_recall_and_ties(spark, n, spread, leaf):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    v = [list(map(float, centres[i % 20] + spread * rng.normal(size=16))) for i in range(n)]
    rows = [(i, x) for i, x in enumerate(v)] + [(50_000 + i, v[0]) for i in range(60)] + [(70_000, None), (70_001, [0.0] * 16), (70_002, [float("nan")] * 16), (70_003, [1.0, None]), (None, v[1])]
    other = [(80_000, [1.0]), (80_020, [2.0, 0.5]), (80_001, [1.0, 1.0]), (80_040, [3.0]), (80_060, [])]  # answered among their own length
    got = neighbours.nearest(spark.createDataFrame([(*r, "s", 0.5) for r in rows + other], "vec_id long, embedding array<double>, point string, leaf double"), leaf_entries=leaf).collect()
    pool = {i: np.array(x) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and np.any(x)}
    ids = np.array(sorted(pool))
    m, hits, total = np.array([pool[i] for i in ids]), 0, 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert [(r["vec_id"], r["score"]) for r in by.pop(80_000)] == [(80_040, 3.0)] and [(r["vec_id"], r["score"]) for r in by.pop(80_020)] == [(80_001, 2.5)] and [r["vec_id"] for r in by.pop(80_040)] == [80_000]
    for q in ids[ids % 20 == 0]:
        s = m @ pool[q]
        order = [int(ids[k]) for k in np.lexsort((ids, -np.round(s, 9))) if ids[k] != q][:20]
        own = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r["vec_id"] for r in own}
        assert all(abs(r["score"] - float(np.dot(pool[r["vec_id"]], pool[q]))) < 1e-9 for r in own)
        hits, total = hits + len({r["vec_id"] for r in own} & set(order)), total + 20
    assert set(by) == set(ids[ids % 20 == 0].tolist()) and hits / total >= 0.9
    assert neighbours.nearest(spark.createDataFrame(rows[-5:-1], "vec_id long, embedding array<double>")).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert neighbours.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).count() == 2


# 1 toxicity
def plain_weight(clause):
    """A clause's weight by looking back from each of its words, one rule after the other."""
    insult = lambda x: x in toxicity.INSULTS
    words = [{"kind": x, "share": 1.0} for x in clause]
    spent = -1  # a negation reaches three words on, and only the first insult or harm there
    for i, w in enumerate(words):
        if w["kind"] in toxicity.INSULTS + toxicity.HARM and any(words[j]["kind"] == toxicity.NEGATION for j in range(max(spent + 1, i - 3), i)):
            w["negated"], spent = True, i
    for w in words:
        if w["kind"] == toxicity.NEGATION or (w.get("negated") and w["kind"] == toxicity.HARM):
            w["kind"] = toxicity.OTHER
        elif w.get("negated"):
            w["kind"], w["share"], w["level"] = toxicity.OTHER, 0.15, int(w["kind"])
    for i, w in enumerate(words):  # a report reaches insults as long as three other words are between
        reports = [j for j in range(i) if words[j]["kind"] == toxicity.REPORT]
        if insult(w["kind"]) and reports and sum(not insult(x["kind"]) for x in words[reports[-1] + 1 : i]) <= 3:
            w["share"] = 0.5
    total, targeted = 0.0, set()
    for i, w in enumerate(words):  # targets two words before or after a plain insult, each for one
        plain = insult(w["kind"]) and w["share"] == 1.0
        before = [j for j in (i - 2, i - 1) if j >= 0 and words[j]["kind"] == toxicity.TARGET]
        if plain and before and not any(insult(x["kind"]) and x["share"] == 1.0 for x in words[before[-1] + 1 : i]):
            total, w["aimed"] = total + 0.5, True
        if w["kind"] == toxicity.TARGET:
            near = [j for j in (i - 2, i - 1) if j >= 0 and insult(words[j]["kind"]) and words[j]["share"] == 1.0]
            if near and not words[near[-1]].get("aimed") and not any(x["kind"] == toxicity.TARGET for x in words[near[-1] + 1 : i]):
                total += 0.5
    for i, w in enumerate(words):  # intent, harm within three words, target within two
        if w["kind"] == toxicity.TARGET:
            harms = [j for j in (i - 2, i - 1) if j >= 0 and words[j]["kind"] == toxicity.HARM]
            if harms and not any(x["kind"] in (toxicity.TARGET, toxicity.INTENT) for x in words[harms[-1] + 1 : i]):
                k = harms[-1]
                intents = [j for j in range(max(0, k - 3), k) if words[j]["kind"] == toxicity.INTENT]
                if intents and not any(x["kind"] == toxicity.HARM for x in words[intents[-1] + 1 : k]):
                    total += 2.5
    seen = False
    for w in words:
        level = int(w["kind"]) if insult(w["kind"]) else w.get("level")
        if level is not None:
            total += (level + 1) * 0.5 * w["share"] * (0.6 if seen else 1.0)
            seen = True
    return total


def test_clauses_weigh_what_their_rules_say():
    rng, machine = random.Random(9), toxicity.grammar()
    letters = "ooonrtwk0357"
    for _ in range(4000):
        clause = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
        assert machine.weigh(clause) == pytest.approx(plain_weight(clause)), clause


# 8 decontamination
def test_decontamination_in_sets_and_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "short item"), (10, item + " twelve"), (3, "!!!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before {item.upper()} after the end of it all and more"), (2, "A Short-Item here"), (3, "clean words only"), (4, item)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination_report(docs, bench).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"]) == (20, 11, 2) and got[1]["items_sha256"] == hashlib.sha256(b"1,10").hexdigest()
    assert got[2]["n_hit"] == 2 and not got[3]["contaminated"] and got[3]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    many = {r["doc_id"]: (sum(s["last"] - s["first"] + 1 for s in r["spans"]), r["items"]) for r in decontaminate.find_contamination(docs, bench, set_bytes=900).collect()}
    assert many == {i: (got[i]["n_hit"], [["1", "10"], ["2"], [], ["1", "10"]][i - 1]) for i in got}
    cut = {r["doc_id"]: (sum(s["last"] - s["first"] + 1 for s in r["spans"]), r["items"]) for r in decontaminate.find_contamination(docs, bench, set_bytes=3000, piece_windows=1).collect()}
    assert cut == many and decontaminate.pieces_of("a b c d", 3, 1) == [("a b c", 3), ("b c d", 3)] and decontaminate.pieces_of("a b", 3) == [("a b", 2)] and decontaminate.pieces_of(" ", 3) == []
    kept = {r["doc_id"]: r["text"] for r in decontaminate.remove_contamination(docs, bench, drop_share=0.9).collect()}
    assert kept == {1: "Before  after the end of it all and more", 2: "A  here", 3: "clean words only"}


def test_window_set_near_its_bound():
    """A set is as large as told before it was built, and finds what a plain search finds."""
    import pickle

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(str(k % 900), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for k in range(2500)]
    held = decontaminate.WindowSet(rows, 10)
    told = sum(len(t) + decontaminate.WORD_BYTES * len(t.split()) for _, t in rows)
    assert len(pickle.dumps(held)) < 1.5 * told + (1 << 20) * len(held.by_size)
    plain = {}
    for item, text in rows:
        words = text.split()
        for i in range(max(1, len(words) - 9)):
            plain.setdefault(tuple(words[i : i + 10]), set()).add(item)
    texts = [" ".join([*(rng.choice(vocabulary) for _ in range(5)), *rng.choice(rows)[1].split()[: rng.randint(1, 30)], "Zz"]) for _ in range(200)]
    n_words, spans, items = held.find(pa.array(texts))
    for text, n, own, found in zip(texts, n_words, spans, items):
        words = text.lower().split()
        hits = [(i, i + size) for size in range(1, 11) for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in plain]
        assert n == len(words) and {p for a, b in hits for p in range(a, b)} == {p for a, b in own for p in range(a, b + 1)}
        assert found == {x for a, b in hits for x in plain[tuple(words[a:b])]}


# 9 WARC
def test_warc_round_trip(spark, tmp_path):
    body = "line\r\n\r\nWARC/1.1\r\n é" + "x" * 100
    rows = [(3, "http://a/\r\nb", body), (1, None, body), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", body), (7, "u", body), (8, "u", "y" * 100), (8, "u", "y" * 100)]
    rows += [(20, "u", "A" * 200), (20, "u", "B" * 300), (21, "u", "A" * 200), (None, "u", "C" * 200), (22, "u", "z" * 5000), (23, "u", "z" * 5000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, long int").repartition(3)
    for place, options in (("a", {}), ("b", {"large_bytes": 1000, "file_bytes": 2000})):
        warc.write_archives(pages, str(tmp_path / place), **options)
    key = lambda r: tuple((x is None, x) for x in (r["page_id"], r["payload_digest"]))
    got = sorted(warc.capture_report(spark, pages, str(tmp_path / "c")).collect(), key=key)
    first = {body: 1, "A" * 200: 20, "z" * 5000: 22}
    want = []
    for i, _, t in rows:
        t = t or ""
        again = i is not None and len(t) >= 100 and first.get(t, i) < i
        want.append({"page_id": i, "payload_bytes": len(t.encode()), "payload_digest": hashlib.sha256(t.encode()).hexdigest(), "record_type": "revisit" if again else "response", "refers_to": first[t] if again else None, "has_request": True})
    assert [r.asDict() for r in got] == sorted(want, key=key)
    for place in "ab":
        records = warc.read_archives(spark, str(tmp_path / place))
        assert records.select("record_id").distinct().count() == 3 * len(rows)
        nested = warc.assemble(records).filter("page_id = 1").first()
        assert bytes(nested["capture"]["payload"]).decode() == body and nested["metadata"] is not None
    assert warc.capture_report(spark, pages.limit(0)).count() == 0


# 10 personal data
FORMS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+".replace(r"[\x20-]", "[ -]")), ("phone", r"\+[0-9][ ().0-9-]+[0-9]"))


def base(text):
    out = []
    for rank, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_pii_base_against_brute_force(spark):
    rng = random.Random(7)
    texts = ["a@b.c_d@e.f x@y..z a.b.@c.d.e. @a.b", "1.2.3.4.5.6.7.8 001.02.255.256 00000000255.1.1.1", "4111 1111-1111  1111 4111-1111-1111-1111 4111111111111111", "+1 (017) 555-7713 +12 +1(((2 ++44 20 7946 0958.", "😀é a@b.co 4111111111111111", "", None, "a" * 50_000 + "@" + "b." * 1500 + "c " + "9" * 20_000 + " " + "1 " * 9000, "x\x01y\x02@a.b 1\x012"]
    texts += ["".join(rng.choice("0123456789012345 -.+@ab()é") for _ in range(120)) for _ in range(300)]
    texts += [" ".join(rng.choice(["4111111111111111", "4111 1111 1111 1111", "10.0.0.1", "x.y@z.org", "+44 20 7946 0958", "word"]) for _ in range(12)) for _ in range(50)]
    got = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, t and t[:80], want, got[i]["spans"])
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
        assert got[i]["n_card"] == want.count("card:") and got[i]["n_phone"] == want.count("phone:")


def test_pii_contexts_find_unseen_identifiers(spark):
    known = [(i, f"Report {i}: mobile number +44 20 7946 {1000 + i} today please.") for i in range(30)]
    unseen = [(100, "Report x: mobile number 0207946-1234 today please."), (101, "Ratio of parts 0207946-1299 seen in this sample.")]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(spark.createDataFrame(known + unseen, "doc_id long, text string")).collect()}
    assert all(got[i].startswith("phone:") for i in range(30))
    assert got[100] == "phone:24:36" and got[101] == ""


def test_pii_contexts_find_other_shapes(spark):
    """Unseen phones, addresses and cards in contexts of two words, one word, at the text's start and after only."""
    cards = [f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}" for d in (str(4111_1111_1111_0000 + i) for i in range(400)) if base(d).startswith("card")]
    known = [(i, f"Report {i}: mobile number +44 20 7946 {1000 + i} today please.") for i in range(30)]
    known += [(100 + i, f"Phone: +44 20 7946 {2000 + i}") for i in range(30)] + [(200 + i, f"+44 20 7946 {3000 + i} is my home line") for i in range(30)]
    known += [(300 + i, f"please write to user{i}@host{i}.org for details") for i in range(30)] + [(400 + i, f"paid with card {c} yesterday evening") for i, c in enumerate(cards[:30])]
    unseen = [
        ("Report x: mobile number 0207946-1234 today please.", "phone", "0207946-1234"),
        ("Report x: mobile number (020) 7946 1235, today please.", "phone", "(020) 7946 1235"),
        ("Phone: 020 7946 1236", "phone", "020 7946 1236"),
        ("020 7946 1237 is my home line", "phone", "020 7946 1237"),
        ("please write to jane(at)host.org for details", "email", "jane(at)host.org"),
        ("please write to root@localhost for details", "email", "root@localhost"),
        ("paid with card 4111-1111-1111-1112 yesterday evening", "card", "4111-1111-1111-1112"),
        ("paid with card 4111 1111 1111 1113 yesterday evening", "card", "4111 1111 1111 1113"),
        ("Ratio of parts 0207946-1299 seen in this sample.", None, None),
        ("please write to 0207946-1298 for details", None, None),
    ]
    docs = known + [(1000 + i, t) for i, (t, _, _) in enumerate(unseen)]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (t, kind, hit) in enumerate(unseen):
        assert got[1000 + i] == (f"{kind}:{t.index(hit)}:{t.index(hit) + len(hit)}" if kind else ""), t


def test_redaction(spark):
    df = spark.createDataFrame([(1, "write to x@y.org or 10.0.0.1 now")], "doc_id long, text string")
    found = pii.find_pii(df, "doc_id", "text")
    assert found.select(pii.redacted(found["text"], "spans").alias("t")).first()["t"] == "write to [email] or [ip] now"
