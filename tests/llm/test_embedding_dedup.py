import math

import numpy as np
import pytest

from eventloom.llm import embedding_dedup
from eventloom.llm.embedding_dedup import _small_forest, fit, near_duplicates, near_forest, plan_for, tables_for, unit


def brute(rows, threshold=0.9):
    """n_links and component of (id, vector), by all pairs."""
    good = {k: np.array(v) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    parent, links = {k: k for k in good}, dict.fromkeys(range(len(rows)), 0)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = list(good)
    x = unit(np.stack([good[k] for k in keys]))
    near = x @ x.T >= threshold
    for a in range(len(keys)):
        for b in np.flatnonzero(near[a]):
            if a != b:
                links[keys[a]] += 1
                p, q = find(keys[a]), find(keys[b])
                parent[max(p, q)] = min(p, q)
    low = {}
    for k in keys:
        low[find(k)] = min(low.get(find(k), 1 << 60), rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        c = low[find(k)] if k in good else i
        out.append((i, links[k], c, i == c))
    return sorted(out)


@pytest.mark.parametrize("dimension", [64, 12])
def test_against_all_pairs(spark, dimension):
    rng = np.random.default_rng(dimension)
    base = rng.standard_normal((120, dimension))
    vectors = [b + 0.12 * rng.standard_normal(dimension) for b in base for _ in range(rng.integers(1, 6))]
    vectors += [vectors[3]] * 40 + [2.5 * vectors[5]] + [vectors[0] + 0.1 * rng.standard_normal(dimension) for _ in range(300)]
    rows = list(enumerate(np.array(vectors)[rng.permutation(len(vectors))].tolist()))
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = near_duplicates(frame).collect()
    want = brute(rows)
    mine = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got)
    assert len(mine) == len(want)
    found, true = sum(r[1] for r in mine), sum(r[1] for r in want)
    assert found <= true and found >= 0.97 * true
    if dimension == 64:
        assert sum(a == b for a, b in zip(mine, want)) >= 0.95 * len(want)


def test_forests_join_the_same():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (6, 2), dtype=np.uint64)
    codes = base[rng.integers(0, 6, 200)] ^ (np.uint64(1) << rng.integers(0, 63, (200, 2), dtype=np.uint64))
    codes = np.concatenate([codes, rng.integers(0, 2**63, (40, 2), dtype=np.uint64)])

    def parts(edges):
        root = list(range(len(codes)))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [min(x, y) if r == max(x, y) else r for r in root]
        return root

    rep = np.arange(len(codes))
    for near in (2, 4, 50, 56):
        first, second = near_forest(rep, codes, near), _small_forest(rep, codes, near)
        assert parts(first) == parts(second) and len(first) == len(second) < len(codes)


def test_rotation_fits_signs():
    rng = np.random.default_rng(6)
    x = unit(rng.standard_normal((2000, 64)) * np.linspace(3, 0.2, 64))
    quantiser = fit(x)
    bits = (x - quantiser.mean) @ quantiser.projections > 0
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.15  # balanced
    assert quantiser.codes(x).shape == (2000, 2)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    out = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got}
    assert len(got) == 11
    assert out == {(1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (None, 3, 1, False)}
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_every_length_is_linked(spark):
    rng = np.random.default_rng(11)
    rows = []
    for dimension, n in ((64, 60), (48, 30), (3, 1)):
        for base in rng.standard_normal((n, dimension)):
            rows += [base.tolist(), (base + 0.05 * rng.standard_normal(dimension)).tolist()]
    rows = list(enumerate([*rows, rows[0], rows[120], [1.0], [1.0], [2.0, 1.0], [2.0, 1.0]]))
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = sorted(r for d in (64, 48, 3, 2, 1) for r in brute([x for x in rows if len(x[1]) == d]))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want


def test_large_and_small_numbers_and_ids_of_strings(spark):
    rows = [("a", [1e200, 1e200]), ("b", [1.0, 1.0]), ("c", [1e-300, 1e-300]), ("d", [5e-324, 0.0]), ("e", [3.0, 0.0]), ("ü", [1e308, -1e308]), (None, [1.0, 1.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {("a", 3, "a", True), ("b", 3, "a", False), ("c", 3, "a", False), ("d", 1, "d", True), ("e", 1, "d", False), ("ü", 0, "ü", True), (None, 3, "a", False)}


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_hot_buckets_are_dealt_into_blocks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(embedding_dedup, "CODES", 40)
    monkeypatch.setattr(embedding_dedup, "HOT_ROWS", broadcast)
    rng = np.random.default_rng(13)
    hot = [rng.standard_normal(32)]
    for _ in range(400):  # a chain of near vectors
        hot.append(hot[-1] + 0.06 * rng.standard_normal(32))
    base = rng.standard_normal((100, 32))
    rows = list(enumerate([*(x.tolist() for x in hot), *(b.tolist() for b in base), *((b + 0.05 * rng.standard_normal(32)).tolist() for b in base)]))
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute(rows)
    mine = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got)
    assert sum(r[1] for r in mine) >= 0.99 * sum(r[1] for r in want)
    assert sum(a == b for a, b in zip(mine, want)) >= 0.99 * len(want)


def test_tables_grow_with_the_vectors():
    for n, width in ((10**4, 16), (10**7, 16), (10**9, 23), (10**10, 27)):
        tables, near = tables_for(n, 0.9)
        assert abs(len(tables[0]) - width) <= 1 and n * (len(tables[0]) + 1) >> len(tables[0]) <= 4096 and near == 36
        assert all(len(np.unique(t)) == len(t) for t in tables)


@pytest.mark.parametrize("substring", [16, 24])
def test_recall_at_the_threshold(substring):
    """Of pairs just above the threshold, tables of either width bring more than nine in ten together."""
    rng = np.random.default_rng(17)
    x = unit(rng.standard_normal((4000, 64)))
    y = rng.standard_normal((4000, 64))
    y = unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    y = 0.905 * x + math.sqrt(1 - 0.905**2) * y
    quantiser = fit(np.concatenate([x, y]))
    a, b = (np.unpackbits(quantiser.codes(v).view(np.uint8).reshape(len(v), 16), axis=1, bitorder="little") for v in (x, y))
    tables, near = tables_for(1000, 0.9, substring)
    met = np.any([(a[:, t] != b[:, t]).sum(axis=1) <= 2 for t in tables], axis=0) & ((a != b).sum(axis=1) <= near)
    assert met.mean() > 0.9


def cloud(n, dimension, noise, seed):
    """Vectors that share a common part."""
    rng = np.random.default_rng(seed)
    return unit(unit(rng.standard_normal((1, dimension))) + noise * rng.standard_normal((n, dimension)) / math.sqrt(dimension))


@pytest.mark.parametrize("dimension, noise", [(64, 0.30), (64, 0.33), (8, 0.33), (256, 0.345), (64, 0.6)])
def test_recall_off_centre(spark, dimension, noise):
    x = cloud(1200, dimension, noise, 23)
    rng = np.random.default_rng(29)
    x = np.concatenate([x, unit(x[:300] + 0.2 * rng.standard_normal((300, dimension)) / math.sqrt(dimension))])
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()
    found = np.array([n for _, n in sorted((r.vec_id, r.n_links) for r in got)])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum() > 0


def test_plans_follow_the_vectors():
    rng = np.random.default_rng(31)
    central, common = unit(rng.standard_normal((3000, 64))), cloud(3000, 64, 0.33, 37)
    quantiser, tables, near = plan_for(central, 3000, 0.9)
    assert np.abs(quantiser.mean).max() > 0 and len(tables) <= 12 and near <= 44
    other = plan_for(common, 3000, 0.9)
    assert other is None or not other[0].mean.any()


def test_tables_are_shuffled_one_after_the_other(spark, monkeypatch):
    """No step of many codes writes all tables' places at once, and no shuffle file outlives its step."""
    from eventloom.llm.common import Scratch

    written = []
    save = Scratch.save

    def seen(self, df, name):
        out = save(self, df, name)
        written.append((name, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")))
        return out

    monkeypatch.setattr(Scratch, "save", seen)
    monkeypatch.setattr(embedding_dedup, "PLACED", 1000)
    rng = np.random.default_rng(41)
    base = rng.standard_normal((300, 16))
    rows = list(enumerate([*base.tolist(), *(base + 0.05 * rng.standard_normal((300, 16))).tolist()]))
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute(rows)
    assert sum(a == b for a, b in zip(sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), want)) >= 0.95 * len(want)
    assert len([name for name, _ in written if "-forests-" in name]) > 2
    assert {kept for _, kept in written} == {"false"}  # as the session had it


def test_clusters_are_sent_in_passes(spark, monkeypatch):
    """However many blocks a cluster has, no pass sends many more vectors than the clusters have."""
    rng = np.random.default_rng(11)
    vectors = (rng.standard_normal(16) * 2 + rng.standard_normal((400, 16))).astype(np.float32)
    vectors[7] = vectors[3]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    for name, value in (("LINKED", 25), ("SENT", 100)):
        monkeypatch.setattr(embedding_dedup, name, value)
    passes, save = [], embedding_dedup.Scratch.save

    def spy(self, df, name):
        passes.append(name) if name.startswith("links-16-") else None
        return save(self, df, name)

    monkeypatch.setattr(embedding_dedup.Scratch, "save", spy)
    monkeypatch.setattr(embedding_dedup, "plan_for", lambda *_: None)  # all are one cluster
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(rows).collect())
    assert len(passes) >= 16  # of 400 / 25 blocks
    want = brute([(k, v.tolist()) for k, v in enumerate(vectors)])
    assert found == want and sum(n for _, n, _, _ in want) > 400
