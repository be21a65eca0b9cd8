"""Clusters by density against a plain hierarchy built from all distances."""

import numpy as np
import pytest

from corpuslens.operators import density


def plain(points, least, samples):
    """Labels of HDBSCAN, top down over a full distance matrix; -1 is noise."""
    x = np.array(points, dtype=float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, samples - 1] if len(x) >= samples else np.full(len(x), np.inf)
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    np.fill_diagonal(reach, 0)

    def parts(members, border):
        """Components of the members when edges of at least the border are gone."""
        left, out = set(members), []
        while left:
            grow = [left.pop()]
            for i in grow:
                near = [j for j in left if reach[i, j] < border]
                left.difference_update(near)
                grow += near
            out.append(grow)
        return out

    def split(members):
        """The largest edge at which the members fall apart, and into what."""
        for border in sorted({reach[i, j] for i in members for j in members if i < j}, reverse=True):
            found = parts(members, border)
            if len(found) > 1:
                return border, found
        return 0.0, [[i] for i in members]

    chosen = []

    def walk(members, born, root):
        """Stability of the best choice under a cluster, and that choice."""
        stable, left = 0.0, members
        while True:
            border, found = split(left)
            density = 1 / max(border, 1e-12)
            large = [p for p in found if len(p) >= least]
            if len(large) == 1:
                stable += (len(left) - len(large[0])) * (density - born)
                left = large[0]
                continue
            stable += len(left) * (density - born)
            break
        below = [walk(p, density, False) for p in large]
        if not root and stable >= sum(s for s, _ in below):
            return stable, [members]
        return max(stable, sum(s for s, _ in below)), [c for _, own in below for c in own]

    label = np.full(len(x), -1)
    if len(x) >= least:
        _, chosen = walk(list(range(len(x))), 0.0, True)
        for k, members in enumerate(chosen):
            label[members] = k
    return label


def groups(labels):
    out = {}
    for i, k in labels:
        out.setdefault(k, set()).add(i)
    return sorted(map(sorted, out.values()))


def run(spark, levels, **how):
    rows = [(level, i, [float(v) for v in x]) for level, points in levels.items() for i, x in enumerate(points)]
    got = density.clusters(spark.createDataFrame(rows, "level int, id long, vector array<double>"), **how).collect()
    out = {level: [] for level in levels}
    noise = {level: set() for level in levels}
    for r in got:
        if r["noise"]:
            noise[r["level"]].add(r["id"])
        else:
            out[r["level"]].append((r["id"], r["cluster"]))
    assert len({r["cluster"] for r in got if r["noise"]}) == sum(map(len, noise.values()))
    return {level: (groups(out[level]), noise[level]) for level in levels}


def expected(points, least, samples):
    label = plain(points, least, samples)
    return groups([(i, k) for i, k in enumerate(label) if k >= 0]), {i for i, k in enumerate(label) if k < 0}


@pytest.fixture(scope="module")
def levels():
    g = np.random.default_rng(5)
    tight, wide, far = g.normal(0, 0.05, (40, 3)), g.normal(3, 0.6, (40, 3)), g.uniform(-8, 8, (15, 3))
    chain = np.c_[np.arange(30) * 0.3, g.normal(0, 0.02, (30, 2))]
    return {0: np.r_[tight, wide, far], 1: np.r_[chain, g.normal(6, 0.3, (20, 3))], 2: g.normal(0, 1, (3, 3)), 3: g.normal(0, 1, (25, 3))}


def test_two_densities_and_noise(spark, levels):
    got = run(spark, levels, min_cluster_size=5)
    assert got == {k: expected(x, 5, 5) for k, x in levels.items()}
    assert len(got[0][0]) >= 2 and got[0][1] and got[2] == ([], {0, 1, 2})


def test_many_blocks_and_rounds(spark, levels):
    """The same over blocks of a dozen nodes, and with trees that no task may hold."""
    some = {k: levels[k] for k in (0, 1)}
    want = {k: expected(x, 4, 3) for k, x in some.items()}
    assert run(spark, some, min_cluster_size=4, min_samples=3, block=12) == want
    assert run(spark, some, min_cluster_size=4, min_samples=3, few=0) == want


def test_equal_vectors_null_and_none(spark):
    x = [[0.0, 0.0]] * 6 + [[5.0, 5.0 + i / 10] for i in range(6)] + [[50.0, -50.0]]
    clusters, noise = run(spark, {0: x}, min_cluster_size=5)[0]
    assert clusters == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11]] and noise == {12}
    df = spark.createDataFrame([(None, 1, None), (None, 2, [1.0]), (1, 3, [])], "level int, id long, vector array<double>")
    assert all(r["noise"] for r in density.clusters(df).collect()) and density.clusters(df.limit(0)).count() == 0


def test_few_distances_of_two_blocks_are_worked_out(monkeypatch):
    import numpy as np

    from corpuslens.operators import density

    draw, made = np.random.default_rng(4), []
    plain = density._each
    monkeypatch.setattr(density, "_each", lambda x, y, i, j: made.append(len(i)) or plain(x, y, i, j), raising=False)
    for shift in (0.0, 1e6):
        x = [draw.normal(size=(300, 64)) + shift for _ in range(2)]
        d = density._distances(*x)
        cores = [np.sort(density._distances(y, y), axis=1)[:, 4] for y in x]
        nodes, parts = [np.arange(300) + 1000 * k for k in range(2)], [draw.integers(0, 9, 300) for _ in range(2)]
        b, o = (density._Block(nodes[k].tobytes(), np.ones(300, np.int64).tobytes(), x[k].tobytes(), cores[k].tobytes(), parts[k].tobytes()) for k in range(2))
        w = np.where(parts[0][:, None] == parts[1][None], np.inf, np.maximum(d, np.maximum(cores[0][:, None], cores[1][None])))
        made.clear()
        got = density._cheapest(b, o)
        assert dict(zip(got["part"], got["w"])) == {p: w[parts[0] == p].min() for p in set(parts[0].tolist())}
        assert sum(made) <= d.size / 20
        made.clear()
        near = np.concatenate([x for _, _, x, _ in density._nearest(b, o, 5, False)])
        assert (np.sort(near, axis=1) == np.sort(d, axis=1)[:, :5]).all() and 0 < sum(made) <= d.size / 20
