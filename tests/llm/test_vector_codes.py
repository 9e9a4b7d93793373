import hashlib
import random

import numpy as np
import pytest

from eventloom.llm import vector_codes
from eventloom.llm.vector_codes import Heaps, codes, compress, distances, nearest, whole

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, scale=4096, parts=8, entries=16, rounds=6):
    """id, code, error of (id, ints, label) rows in the order of ids, and the codebooks, with every comparison made."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(scale * v)) for v in r[1]] for r in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for v in x] for p in range(parts)]
    books = [[list(v) for v in part[:entries]] for part in cut]

    def near(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in book]
        return min(range(len(d)), key=lambda c: (d[c], c))

    for _ in range(rounds):
        for p in range(parts):
            at = [near(v, books[p]) for v in cut[p]]
            for c in range(len(books[p])):
                mine = [v for v, k in zip(cut[p], at) if k == c]
                if mine:
                    books[p][c] = [sum(column) // len(mine) for column in zip(*mine)]
    out = []
    for i, r in enumerate(rows):
        code = [near(cut[p][i], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{c:02x}" for c in code), sum((a - b) ** 2 for p in range(parts) for a, b in zip(cut[p][i], books[p][code[p]])), r[2]))
    return out, hashlib.sha256(",".join(str(n) for part in books for entry in part for n in entry).encode()).hexdigest()


def check(spark, rows, usable=None, **how):
    want, sha = brute(usable if usable is not None else rows, **how)
    by_label = {}
    for _, _, e, label in want:
        by_label[label] = by_label.get(label, 0) + e
    got = codes(spark.createDataFrame(rows, SCHEMA).repartition(5), **how).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == sorted(((i, c, e, by_label[label]) for i, c, e, label in want), key=str)
    assert {r.codebooks_sha256 for r in got} == {sha}


def cloud(n, dimension, seed, hot=0.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dimension)] for _ in range(9)]
    same = [rnd.gauss(0, 1) for _ in range(dimension)]
    return [(i, list(same) if rnd.random() < hot else [c + rnd.gauss(0, 0.3) for c in rnd.choice(centres)], rnd.choice([None, 1, 2])) for i in range(n)]


def test_equal_to_all_comparisons(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    check(spark, cloud(400, 16, 1))
    check(spark, cloud(300, 8, 2, hot=0.4))  # a vector that very many rows are, ties among entries
    check(spark, [(i, [float(i % 3)] * 8, 1) for i in range(90)])  # nothing but ties


def test_few_parts_are_compared_again(spark):
    out = compress(spark.createDataFrame(cloud(1500, 16, 3), SCHEMA))
    assert out.compared[0] == 1500 * 8 and len(out.compared) <= 6
    assert sum(out.compared[1:]) < 0.7 * 1500 * 8 * (len(out.compared) - 1)


def test_unusable_few_and_no_rows(spark):
    good = cloud(5, 16, 4)
    bad = [(100, None, 1), (101, [float("nan")] * 16, 1), (102, [float("inf")] * 16, None), (103, [None] + [1.0] * 15, 1), (104, [], 1), (105, [1.0] * 8, 1), (106, [1.0] * 15, 1)]
    check(spark, good + bad, good)
    again = [(None, [0.5] * 16, None), (3, [0.25] * 16, 1), (3, [0.25] * 16, 1)]
    check(spark, good + again)
    assert codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes(spark.createDataFrame(bad[:5], SCHEMA)).count() == 0
    check(spark, [(i, [2.0**40 * (i - 3)] * 8, 1) for i in range(7)] if False else [(i, [float(2**12 * (i - 3))] * 8, 1) for i in range(30)])
    with pytest.raises(Exception, match="too large"):
        codes(spark.createDataFrame([(1, [1e300] * 8, 1)], SCHEMA)).collect()


def test_names_and_other_ids(spark):
    rows = [(f"n{i}", v, "own", "own", "own") for i, v, _ in cloud(40, 8, 6)]
    out = codes(spark.createDataFrame(rows, "VEC_ID string, embedding array<float>, LABEL string, code string, `Error` string"))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = out.collect()
    assert {r.vec_id for r in got} == {r[0] for r in rows} and len({r.label_error for r in got}) == 1


def test_exact_distances():
    rng = np.random.default_rng(1)
    for top in (1 << 12, 1 << 27, 1 << 40):
        x, book = rng.integers(-top, top, (20, 4)), rng.integers(-top, top, (5, 4))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in book] for r in x]
        assert distances(x, book).tolist() == want
    assert whole(np.array([-0.0001, 0.9999, -1.0])).tolist() == [-1, 4095, -4096]
    first, slack = nearest(np.array([[0, 0]]), np.array([[1, 0], [0, 1], [5, 0]]))
    assert first[0] == 0 and slack[0] == 0  # a tie keeps no slack, so it is compared again


def test_heaps_give_back_only_what_drift_has_reached():
    heaps = Heaps(1, 2, None, 5)
    heaps.push(0, np.arange(5), np.array([0, 0, 0, 1, 1]), np.array([3.0, 1.0, 2.0, 0.5, 9.0]))
    kept = Heaps(1, 2, heaps.data(), 5)
    assert kept.assigned()[:, 0].tolist() == [0, 0, 0, 1, 1]
    rows, entries = kept.violated(0, np.array([2.0, 0.1]))
    assert sorted(rows) == [1, 2] and entries == [0, 0] and (0, 1) not in kept.lists
