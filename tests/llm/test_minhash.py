"""Operator 13 against all pairs."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from filamenta.llm import minhash
from filamenta.llm.queries import QUERIES


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()


def plain(rows):
    """[(doc_id, n_shingles, component_id, kept)] by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    met = {p for ks in holders.values() for p in itertools.combinations(ks, 2)}
    for a, b in met:
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), least.get(top(k)), i == least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def results(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def drawn(seed):
    """Groups of copies, of near copies on both sides of the bound and chains of them, and texts without partners."""
    rng = random.Random(seed)
    texts = []
    for g in range(14):
        base = [f"W{g}x{rng.randrange(400)}" for _ in range(rng.choice([2, 3, 5, 40, 120, 300]))]
        texts += [" ".join(base)] * rng.randint(1, 3) + [" \t\n".join(base).upper()]
        for _ in range(10):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6, 9]))))
        chain = base
        for _ in range(5):
            chain = edited(rng, chain, 1)
            texts.append(" ".join(chain))
    texts += [None, "", " \t", "one", "One", "one two", "Ünï Ünï"] + [" ".join(f"r{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    ids = rng.sample(range(-50, 3 * len(texts)), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("tile, elections, sketched", [(minhash.TILE, 2, 1024), (3, 0, 60)])
def test_groups_equal_all_pairs(spark, monkeypatch, tile, elections, sketched):
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "ELECTIONS", elections)
    monkeypatch.setattr(minhash, "SKETCHED", sketched)
    rows = drawn(tile)
    df = spark.createDataFrame([(*r, 0, 0, "s", 0) for r in rows], "doc_id long, text string, node int, n int, h string, c int").repartition(3)
    assert results(minhash.minhash_groups(df)) == plain(rows)


def test_query_equals_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert results(QUERIES["op13_minhash"](spark, sf)) == plain(rows)


def test_odd_tables(spark):
    of = lambda rows: results(minhash.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert of([]) == []
    words, long = " ".join(map(str, range(60))), " ".join(str(k * k) for k in range(60_000))
    rows = [(None, None), (3, ""), (None, words), (None, words), (9, words + " x"), (9, words), (None, "a b c d"), (None, "a b c d"), (5, long), (2, long + " end")]
    want = [(None, 0, None, True), (3, 0, 3, True), (9, 59, 9, True), (9, 58, 9, True), (None, 58, 9, False), (None, 58, 9, False), (None, 2, None, True), (None, 2, None, True), (2, 59_999, 2, True), (5, 59_998, 2, False)]
    assert of(rows) == sorted(want, key=repr)


def test_minima_estimate_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, np.uint64)
    at = [(minhash.minima(x[: 3000 - k]) == minhash.minima(x[k:])).mean() for k in (0, 243, 1000)]
    assert at[0] == 1 and abs(at[1] - 0.85) < 0.15 and abs(at[2] - 0.5) < 0.2
    assert len(set(minhash.band_keys(minhash.minima(x)).tolist())) == minhash.BANDS


def test_no_link_at_the_bound_is_lost():
    """Of 400 pairs at 0.85, the least that link, each shares a key and agrees in enough minima."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 40, np.uint64)
        a, b = minhash.minima(x[:37]), minhash.minima(x[3:])  # 34 of 40
        assert (a == b).sum() >= minhash.AGREE and (minhash.band_keys(a) == minhash.band_keys(b)).any()


def test_sketches_lose_no_link():
    """Every pair at 0.85 or more passes, at any two levels; most pairs at 0.7 don't."""
    rng = np.random.default_rng(5)
    passed = collections.Counter()
    for n in (3, 40, 300, 1000, 1030, 2060, 5000):
        for share, expected in ((0.85, True), (0.7, False)):
            for _ in range(20):
                x = rng.integers(0, 1 << 63, n, np.uint64)
                moved = int(n * (1 - share) / (1 + share))  # 100 * (n - moved) >= 100 * share * (n + moved)
                y = np.concatenate([x[moved:], rng.integers(0, 1 << 63, moved, np.uint64)])
                rows = []
                for k, s in enumerate((x, y)):
                    level, sampled, deep, sampled_deep, sketch = minhash.sketched(np.unique(s))
                    rows.append({"node": k, "c": k, "n": n, "level": level, "sampled": sampled, "deep": deep, "sampled_deep": sampled_deep, "full": False, "low": bytes(minhash.MINIMA), "sketch": sketch})
                a, b = (minhash._Side(pa.Table.from_pylist([r])) for r in rows)
                passed[n, expected] += len(minhash._may_link(a, 0, b, np.array([0])))
    assert all(passed[n, True] == 20 for n in (3, 40, 300, 1000, 1030, 2060, 5000))
    assert all(passed[n, False] == 0 for n in (40, 300, 1000, 5000))


def test_a_group_of_links_is_no_square_of_pairs(spark, monkeypatch):
    """Of 60 near copies that all link and that no election joins, tiles name a forest a key, not all pairs."""
    monkeypatch.setattr(minhash, "ELECTIONS", 0)
    counted, confirmed = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda docs, nodes, pairs, *more: counted.append(pairs.count()) or confirmed(docs, nodes, pairs, *more))
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(edited(rng, base, 1))) for k in range(60)]
    assert results(minhash.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    assert 59 <= sum(counted) <= minhash.BANDS * 59


def test_a_tile_names_other_pairs_after_refuted_ones():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, 100, np.uint64)
    own = ("level", "sampled", "deep", "sampled_deep", "sketch")
    rows = []
    for node in (1, 2, 3):
        s = np.unique(np.concatenate([x, rng.integers(0, 1 << 63, node, np.uint64)]))
        one = {"h": 5, "i": 0, "j": 0, "node": node, "c": node, "low": bytes(minhash.MINIMA), "n": len(s)} | dict(zip(own, minhash.sketched(s)))
        rows += [one | {"outside": False}] + [one | {"outside": True}] * (node < 3)
    of = lambda rows, forests: [(r["a"], r["b"]) for t in minhash._tiled(forests)(iter(pa.Table.from_pylist(rows).to_batches())) for r in t.to_pylist()]
    assert of(rows, 1) == [(1, 2), (1, 3)]
    assert of(rows, 4) == [(1, 2), (1, 3), (2, 3)]
    refuted = {"h": 5, "i": 0, "j": 0, "outside": None, "node": 1, "c": 2}
    assert of([*rows, refuted], 1) == [(1, 3), (2, 3)]
    assert of([rows[0] | {"c": 3}, rows[1] | {"c": 3}, *rows[2:], refuted], 1) == [(2, 3)]  # 1 and 3 are in one component by now
    far = [rows[0], rows[1] | dict(zip(own, minhash.sketched(np.unique(rng.integers(0, 1 << 63, 101, np.uint64))))) | {"node": 4, "c": 4}]
    assert of(far + [refuted], 1) == []
