import random

import numpy as np
import pytest

from eventloom.llm import decontamination
from eventloom.llm.decontamination import ANSWER, COVERED, NEARLY_ALL, TILE, _masks, annotate, axes, common_subsequence, contaminated, latent_space, models_for, windows, words_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_against_table():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randint(0, 6) for _ in range(rnd.randint(1, 90))] for _ in range(2))
        assert common_subsequence(_masks(np.array(a, np.uint64)), len(a), b) == lcs(a, b)


def test_axes_against_full_decomposition():
    rng = np.random.default_rng(2)
    left = rng.standard_normal((400, 12)) * np.linspace(10, 1, 12)
    gram = left @ left.T
    omega = rng.standard_normal((400, 30))
    u, values = axes(gram @ omega, omega, 12)
    want, true = np.linalg.eigh(gram)
    assert np.linalg.norm(true[:, -12:] - u @ (u.T @ true[:, -12:])) < 1e-3 and np.allclose(values[::-1], want[-12:], rtol=1e-3)
    rows = rng.standard_normal((5, 400))
    space = latent_space((u, values), rows, 2.0)
    assert space.shape == (400, 17) and np.allclose(space.T @ space, np.eye(17)) and np.allclose(rows @ space @ space.T, rows)


def test_windows():
    assert windows(1, "too short to use") == [] and windows(1, None) == []
    (one,) = windows(1, "What is the colour of the sky on a clear day? Answer: it is blue")
    assert len(one.words) - one.answer == 3
    many = windows(2, " ".join(f"w{k}" for k in range(200)))
    assert [len(w.words) for w in many] == [64] * len(many)
    assert set(np.concatenate([w.words for w in many]).tolist()) == set(words_of(" ".join(f"w{k}" for k in range(200))).tolist())


def corpus():
    rnd = random.Random(3)
    rare = [f"r{k}x" for k in range(3000)]
    common = ["the", "of", "and", "to", "in", "is"]
    text = lambda n: [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(rare) for _ in range(n)]
    items = {k: text(rnd.randint(12, 70)) for k in range(40)} | {90: text(300)}
    docs, truth = {}, set()
    for d in range(400):
        body = text(rnd.choice([5, 60, 300, 1500]))
        if d % 4 == 0:
            k = rnd.choice(list(items))
            leak = list(items[k])
            if d % 8 == 0:  # a paraphrase: some words replaced, some dropped, some added
                leak = [w if rnd.random() > 0.08 else rnd.choice(rare) for w in leak if rnd.random() > 0.05]
                leak.insert(rnd.randrange(len(leak)), "indeed")
            at = rnd.randint(0, len(body))
            body[at:at] = leak
            truth.add((d, k))
        docs[d] = " ".join(body)
        if d % 12 == 0:
            docs[d] = docs[d].upper().replace(" ", ", ")
    return docs, {k: " ".join(v) for k, v in items.items()}, truth


@pytest.mark.parametrize("block,together", [(256, 16), (15, 2)])
def test_planted_passages(spark, monkeypatch, block, together):
    monkeypatch.setattr(decontamination, "WINDOWS", block)
    monkeypatch.setattr(decontamination, "TOGETHER", together)
    docs, items, truth = corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs.items()] + [(None, None, "x"), (1000, "", "x")], "doc_id long, text string, matches string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items.items()] + [(None, "a b c d e f", 1), (77, None, 1), (78, "yes", 1)], "item_id long, text string, doc_id int")
    found = annotate(frame, models_for(frame, bench)).collect()
    assert len(found) == 402
    got = {(r.doc_id, m.item) for r in found for m in r.matches}
    assert got == truth


def test_pairs_and_empty_tables(spark):
    docs, items, truth = corpus()
    frame = spark.createDataFrame(list(docs.items())[:80] * 2, "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = contaminated(frame, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == sorted(x for x in truth if x[0] < 80 for _ in range(2))
    assert contaminated(frame.limit(0), bench).count() == 0
    assert contaminated(frame, bench.limit(0)).count() == 0


def test_many_near_orthogonal_items(spark):
    rnd = random.Random(9)
    rare = [f"q{k}x" for k in range(12_000)]
    # every tenth item is long: windows, not items, fill the latent space
    items = {k: [rnd.choice(rare) for _ in range(rnd.randint(100, 160) if k % 10 == 0 else rnd.randint(15, 60))] for k in range(1000)}
    docs = {}
    for k, words in items.items():
        leak = list(words)
        if k % 2:  # a paraphrase
            leak = [rnd.choice(rare) if i % 9 == 4 and i < 12 else w for i, w in enumerate(leak) if i % 9 != 6 or i >= 12]
        body = [rnd.choice(rare) for _ in range(rnd.choice([5, 60, 200]))]
        at = rnd.randint(0, len(body))
        docs[k] = " ".join(body[:at] + leak + body[at:])
    docs |= {2000 + k: " ".join(rnd.choice(rare) for _ in range(80)) for k in range(500)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in contaminated(frame, bench).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, k) for k in items}


def test_short_items_and_items_without_id(spark):
    items = [(1, "quick brown fox jumps"), (2, "Paris"), (3, "the of the of the of"), (None, "no id but five words"), (1, "another text of item one")]
    docs = [(10, "The quick brown fox jumps!"), (11, "quick brown the fox jumps"), (12, "in paris, now"), (13, "parisian"), (14, "x " * 500 + "the of the of the of " + "y " * 500), (15, "with no id but five words"), (16, "another text of item one"), (17, "fox"), (18, "quick brown"), (19, "fox jumps quick brown")]
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(10, 1), (12, 2), (14, 3), (15, None), (16, 1)}
    named = spark.createDataFrame([(f"d{i}", t, "x") for i, t in docs], "doc_id string, text string, Matches string")
    found = annotate(named, models_for(named, spark.createDataFrame([(f"i{i}", t) for i, t in items], "item_id string, text string")))
    assert found.columns == ["doc_id", "text", "matches"]
    assert {(r.doc_id, m.item) for r in found.collect() for m in r.matches} == {("d10", "i1"), ("d12", "i2"), ("d14", "i3"), ("d15", "iNone"), ("d16", "i1")}


def test_against_all_pairs(spark):
    """Every document and item of the small tables: what the longest common subsequence confirms anywhere in a document is found, and nothing else."""
    folder = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    parts = [w for r in bench.collect() for w in windows(r.item_id, r.text)]
    masks = [(_masks(w.words), _masks(w.words[w.answer :])) for w in parts]
    want = set()
    for r in docs.collect():
        words = words_of(r.text or "").tolist()
        held = set(words)
        for w, (whole, answer) in zip(parts, masks):
            n = len(w.words)
            if sum(x in held for x in w.words.tolist()) < COVERED * n:
                continue
            for a in range(0, max(1, len(words) - n), TILE):
                around = words[max(0, a - n) : a + 2 * TILE + n]
                covered = common_subsequence(whole, n, around) / n
                if covered >= COVERED and (covered >= NEARLY_ALL or common_subsequence(answer, n - w.answer, around) / (n - w.answer) >= ANSWER):
                    want.add((r.doc_id, w.item))
                    break
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == want and want
