"""Ranked search, vector codes and the set join against plain versions, and on messy tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpuslens.llm import codes, ranked, setjoin

CLASHES = ", item int, n int, node long, root long, token long, code string, error long, label_error long, rank int, score double, n_shingles int, part int, v string, prefix string"
EXTRA = (1, 2, 3, 4, 5, "c", 6, 7, 8, 0.5, 9, 10, "v", "p")


# ---- vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Lloyd's rounds in Python's whole numbers; rows are (vec_id, vector), in order."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v in kept), default=0) // parts)
    kept = [(i, v + [0] * (width * parts - len(v))) for i, v in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda x, book: min(range(len(book)), key=lambda j: (far(x, book[j]), j))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v in kept:
                members.setdefault(nearest(cut(v, p), books[p]), []).append(cut(v, p))
            for j, xs in members.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v in kept:
        code = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code))))
    return out, books


def coded(spark, rows):
    df = spark.createDataFrame([(i, v, label, *EXTRA) for i, v, label in rows], "vec_id long, embedding array<double>, label int" + CLASHES)
    return [tuple(r) for r in codes.code_report(df).collect()]


def checked(spark, rows):
    got = coded(spark, rows)
    want, books = plain_codes([(i, v) for i, v, _ in rows])
    labels = {id(r): r[2] for r in rows}
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sums = Counter()
    for (i, _, e), r in zip(want, kept):
        sums[labels[id(r)]] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    want = [(i, c, e, sums[labels[id(r)]], digest) for (i, c, e), r in zip(want, kept)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_codes_equal_plain_rounds(spark):
    g = random.Random(3)
    # Components on a coarse grid, so that distances tie often.
    checked(spark, [(i, [g.choice([-0.5, -0.25, 0.0, 0.25]) for _ in range(8)], g.choice([1, 2, None])) for i in range(400)])


def test_codes_of_messy_vectors(spark):
    g = random.Random(4)
    rows = [(i, [g.gauss(0, 1) for _ in range(8)], 7) for i in range(300)]
    rows += [(300, None, 1), (301, [1.0, None] * 4, 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] * 8, None), (None, [0.5] * 8, None), (5, [0.5] * 8, 7), (5, [0.5] * 8, 7), (304, [0.25] * 5, 2), (305, [], 2)]
    checked(spark, rows)


def test_codes_of_large_components(spark):
    """Beyond 2^53 the distances are whole numbers of Python's."""
    g = random.Random(5)
    checked(spark, [(i, [g.choice([1.0, -1.0]) * 2e4 + g.random() * 1e3 for _ in range(4)], 0) for i in range(270)])


def test_few_vectors_and_none(spark):
    checked(spark, [(1, [0.1] * 6, 1), (2, [0.2] * 6, 1), (3, [0.1] * 6, None)])
    assert coded(spark, []) == []
    with pytest.raises(ValueError):
        coded(spark, [(1, [1e12] * 4, 1)])


def test_bounds_spare_comparisons(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.02).tolist(), 0) for i in range(1500)]
    out, _ = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    scans = [r["scans"] for r in out.collect()]
    assert min(scans) >= 4 and sum(scans) < 0.8 * 20 * len(scans)  # 4 parts, 5 rounds


# ---- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(lower) for t in TERM.findall(text or "")]


def plain_search(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **how):
    docs = spark.createDataFrame([(i, t, *EXTRA) for i, t in docs], "doc_id long, text string" + CLASHES)
    items = spark.createDataFrame([(i, t, *EXTRA) for i, t in items], "item_id long, text string" + CLASHES)
    return sorted([tuple(r) for r in ranked.search(docs, items, **how).collect()], key=str)


@pytest.fixture(scope="module")
def library():
    g = random.Random(11)
    words = ["the", "of", "and"] * 40 + [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(g.choice(words) for _ in range(g.randint(1, 60)))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # equal scores beyond the twentieth
    docs += [(2000, None), (2001, ""), (2002, "... !!"), (None, docs[7][1]), (7, docs[7][1]), (2003, "the THE The " * 5000), (2004, "Éa éa ÉA w5")]
    items = [(i, " ".join(g.choice(words) for _ in range(g.randint(1, 30)))) for i in range(25)]
    items += [(90, docs[7][1]), (91, "nowhere"), (92, None), (93, ""), (None, "w5 éa w5"), (90, docs[7][1]), (0, "w1 w2 w1")]
    return docs, items


def test_search_equals_plain(spark, library):
    docs, items = library
    assert searched(spark, docs, items) == plain_search(docs, [x for x in items if x[1] is not None])


def test_search_by_blocks_of_items(spark, library):
    docs, items = library
    assert searched(spark, docs, items, k=3, item_bytes=600) == plain_search(docs, [x for x in items if x[1] is not None], 3)


def test_search_of_nothing(spark, library):
    docs, items = library
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == [] and searched(spark, [(1, None)], items) == []


def test_suffix_bounds_spare_frequent_terms(library):
    """Terms that cannot bring a document in on their own make no candidates."""
    impacts = ranked.Impacts(1000, 50_000)
    weight = impacts.weights(np.array([5, 900]))
    join = ranked.Join(np.array([0, 0]), np.array([0, 1]), np.array([1, 1]), 1, weight, np.array([500_000, 500_000]), np.array([400_000, 400_000]), impacts, 2)
    assert join.head_item.tolist() == [0] and np.diff(join.head_at).tolist() == [1, 0]
    assert join.suffix[0] == weight[1] * 500_000 < join.threshold[0]


# ---- the set join


def plain_sets(docs):
    out = []
    for _, t in docs:
        w = [x.translate(lower) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain_join(docs):
    sets, root = plain_sets(docs), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(docs):
        if ident is not None:
            least[find(i)] = min(least.get(find(i), ident), ident)
    return sorted([(ident, len(sets[i]), least.get(find(i))) for i, (ident, _) in enumerate(docs)], key=str)


def joined(spark, docs, **how):
    df = spark.createDataFrame([(i, t, *EXTRA) for i, t in docs], "doc_id long, text string" + CLASHES)
    return sorted([tuple(r) for r in setjoin.shingle_join(df, **how).collect()], key=str)


def family(g, n, words, change, start):
    """Texts that share most of a base, each with its own changes: similarities around 0.8."""
    base = [f"b{start}x{i}" for i in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(g.randint(0, change)):
            own[g.randrange(words)] = f"c{g.randrange(40)}"
        out.append((start + k, " ".join(own)))
    return out


@pytest.fixture(scope="module")
def families():
    g = random.Random(21)
    docs = family(g, 60, 120, 4, 100) + family(g, 40, 60, 2, 300) + family(g, 25, 30, 2, 500)
    line = " ".join(f"common{i}" for i in range(60))
    docs += [(700 + k, line + " " + " ".join(f"own{k % 9}y{i}" for i in range(k % 25))) for k in range(80)]
    docs += [(900 + k, " ".join(f"l{g.randrange(6)} is a line of its own kind" for _ in range(20))) for k in range(40)]
    docs += [(2000 + k, docs[5][1]) for k in range(30)]
    docs += [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, "one two three four five"), (7, "one two three four five"), (None, "one two three four five"), (None, "alone it stands here now and then"), (8, "a b c d e " * 4000), (8, "a b c d e " * 4000), (9, "a b c d e"), (-5, docs[70][1])]
    return docs


def test_join_equals_plain(spark, families):
    assert joined(spark, families) == plain_join(families)


def test_join_by_blocks_alone(spark, families):
    assert joined(spark, families, leaders=0, block=4) == plain_join(families)


def test_join_at_the_very_threshold(spark):
    """90 of 110 shingles in common link, 89 of 111 do not: 80 % is 88.8 of 111."""
    word = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    docs = [(1, word(0, 104)), (2, word(10, 114)), (3, word(5000, 5104)), (4, word(5011, 5115)), (5, word(9000, 9084)), (6, word(9000, 9104))]
    assert joined(spark, docs) == plain_join(docs)
    assert plain_join(docs)[0][2] is not None


def test_join_of_nothing(spark):
    assert joined(spark, []) == []
