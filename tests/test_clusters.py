"""Ward's clusters by rounds, against the plain sequential algorithm."""

import numpy as np
import pytest

from filamenta.operators import clusters
from filamenta.sources.shared import Written


def plain_cut(points, weights, k):
    """Labels of k clusters, each step merging the nearest two."""
    own = [[i] for i in range(len(points))]
    while len(own) > k:
        centre = np.array([np.average(points[c], axis=0, weights=weights[c]) for c in own])
        size = np.array([weights[c].sum() for c in own])
        d = size[:, None] * size / (size[:, None] + size) * ((centre[:, None] - centre) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        own[a] += own.pop(b)
    return {frozenset(c) for c in own}


def drawn(seed, n):
    rng = np.random.default_rng(seed)
    return np.round(rng.standard_normal((n, 2)) + rng.integers(0, 6, (n, 1)) * np.array([7, 3]), 6), rng.integers(1, 4, n).astype(float)


@pytest.mark.parametrize("tail", [1024, 5])
def test_cuts_equal_the_plain_ones(spark, tail):
    points, weights = drawn(1, 70)
    points[0] = [500.0, -500.0]  # merges late, from the first round on
    places = spark.createDataFrame([(i, float(x), float(y), float(w)) for i, ((x, y), w) in enumerate(zip(points, weights))], "id long, x double, y double, n double")
    written = Written(spark)
    rounds, rest = clusters.ward_merges(places, written, tail)
    assert len(rest) + sum(r.count() for r in rounds) == 69 and bool(rounds) == (tail == 5)
    for k in (2, 5, 20, 60):
        finest, merges = clusters._finest(places, rounds, rest, k, written)
        got = {}
        for r in finest.collect():
            got.setdefault(r["c"], set()).add(r["id"])
        assert {frozenset(c) for c in got.values()} == plain_cut(points, weights, k) and len(merges) == k - 1
    written.close()


def silhouette(points, labels):
    out = []
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(1))
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a, b = d[own].sum() / (own.sum() - 1), min(d[labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


def test_the_cut_with_the_best_silhouette_is_taken(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TILE", 16)
    points, weights = drawn(2, 40)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.repeat(points, weights.astype(int), 0))]
    got = {r["rid"]: r["g"] for r in clusters.ward_clusters(spark.createDataFrame(rows, "rid long, x double, y double"), "x", "y", "g", 1, range(2, 30)).collect()}
    all_ = np.array([r[1:] for r in rows])
    labels = np.array([got[i] for i in range(len(rows))])
    best = max(silhouette(all_, np.array([next(k for k, c in enumerate(sorted(map(sorted, plain_cut(points, weights, n)))) if i in c) for i, w in enumerate(weights) for _ in range(int(w))])) for n in range(2, 30))
    assert abs(silhouette(all_, labels) - best) < 1e-9
    firsts = [min(map(tuple, all_[labels == g])) for g in range(1, labels.max() + 1)]
    assert firsts == sorted(firsts)


def test_small_clusters_and_odd_tables(spark):
    of = lambda rows, **k: [r["g"] for r in clusters.ward_clusters(spark.createDataFrame(rows, "rid long, x double, y double"), "x", "y", "g", **k).orderBy("rid").collect()]
    clump = lambda at, n: [(at + 0.01 * k, at) for k in range(n)]
    rows = lambda places: [(i, *p) for i, p in enumerate(places)]
    assert of(rows(clump(0.0, 5) + clump(10.0, 6) + clump(13.0, 2) + [(None, 1.0)])) == [1] * 5 + [2] * 8 + [None]
    assert of([]) == [] and of(rows([(1.0, 1.0)])) == [1] and of(rows([(1.0, 1.0)] * 3 + [(2.0, 2.0)])) == [1] * 4
    assert len(set(of(rows([(0.0, 0.0), (1.0, 0.0), (9.0, 0.0), (10.0, 0.0)])))) == 2
    assert set(of(rows([(float(k % 4), float(k // 4)) for k in range(16)] * 2))) <= set(range(1, 17))  # ties everywhere
    assert len(set(of(rows(clump(0.0, 3) + clump(5.0, 3) + clump(50.0, 3)), least=4))) >= 2  # all are small


@pytest.mark.parametrize("windowed", [None, True, False])
def test_even_halves_are_the_most_even_ones(windowed):
    from filamenta.operators.selection import even_halves

    rng = np.random.default_rng(9)
    for _ in range(150):
        sizes = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 30), rng.integers(1, 6), False), rng.integers(1, 9, 6))}
        total, sums = sum(n * c for n, c in sizes.items()), {0}
        for n, c in sizes.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        half = even_halves(sizes, windowed)
        assert all(0 <= half.get(n, 0) <= c for n, c in sizes.items())
        assert sum(n * k for n, k in half.items()) == max(s for s in sums if s <= total // 2), sizes
    huge = {7: 10**12, 12: 10**13 + 1, 100: 3}  # more rows than any table of sums could hold
    half = even_halves(huge)
    assert abs(sum(n * (c - 2 * half[n]) for n, c in huge.items())) <= 1
    assert even_halves({}) == {} and even_halves({5: 1}) == {5: 0} or even_halves({5: 1}) == {}


def test_no_table_has_a_row_a_pair_of_place_and_cluster(spark, monkeypatch):
    sizes = []

    class Counted(Written):
        def keep(self, df):
            out = super().keep(df)
            sizes.append(out.count())
            return out

    monkeypatch.setattr(clusters, "Written", Counted)
    monkeypatch.setattr(clusters, "TILE", 16)
    points, _ = drawn(5, 120)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    out = clusters.ward_clusters(spark.createDataFrame(rows, "rid long, x double, y double"), "x", "y", "g", 1, range(2, 20))
    assert out.where("g is not null").count() == 120 and max(sizes) <= 120


def test_exposure_groups_by_shift_write_no_sums(spark, monkeypatch):
    from filamenta.operators.grouping import exposure_groups_by_shift

    sizes = []
    keep = Written.keep
    monkeypatch.setattr(Written, "keep", lambda self, df: (out := keep(self, df), sizes.append(out.count()))[0])
    points, _ = drawn(6, 60)
    rows = [(i, f"m{i}", 1 + i % 2, float(i), float(x), float(y)) for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "rid long, image string, a_exp_group_id long, tilt double, x double, y double")
    out = exposure_groups_by_shift(df, "a_exp_group_id", "image", "x", "y", ["tilt"], clusters=range(2, 10))
    assert out.count() == 60 and max(sizes) <= 60
