import math
import random
import re

import numpy as np
import pytest

from eventloom.llm.toxicity import HALF, NEIGHBOURS, PLAIN, BlockMaxIndex, monotone, score, train


def sparse(vectors):
    at = np.concatenate([[0], np.cumsum((vectors > 0).sum(axis=1))])
    rows, terms = np.nonzero(vectors)
    return at, terms, vectors[rows, terms]


@pytest.mark.parametrize("seed", range(5))
def test_nearest_against_all_rows(seed):
    rng = np.random.default_rng(seed)
    vectors = rng.random((500, 20)) * (rng.random((500, 20)) < 0.15)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    vectors[250:300] = vectors[0:50]  # ties
    ids = rng.permutation(500)
    index = BlockMaxIndex(*sparse(vectors), ids, 20)
    for n, q in enumerate(vectors[:100]):
        terms = np.flatnonzero(q)
        if not len(terms):
            continue
        without = np.array([n]) if n % 2 else ()
        rows, sims = index.nearest(terms, q[terms], 7, without)
        all_sims = np.round(vectors @ q, 9)
        all_sims[list(without)] = 0
        want = [k for k in np.lexsort((ids, -all_sims))[:7] if all_sims[k] > 0]
        assert rows.tolist() == want
        assert np.allclose(sims, all_sims[want])
    # clustered rows let whole blocks be skipped
    tight = np.zeros((1000, 21))
    tight[np.arange(1000), np.arange(1000) % 20] = 1.0
    tight[:, 20] = 0.01  # a word that all hold
    index = BlockMaxIndex(*sparse(tight), np.arange(1000), 21)
    rows, _ = index.nearest(np.array([3, 20]), np.array([1.0, 0.01]), 7)
    assert rows.tolist() == [3 + 20 * k for k in range(7)] and index.scored < 200
    assert len(index.full) < 21
    assert BlockMaxIndex(*sparse(tight[:0]), np.zeros(0, np.int64), 21).nearest(np.array([3]), np.ones(1), 7)[0].tolist() == []


def test_monotone():
    x, y = monotone(np.array([0.1, 0.2, 0.2, 0.3, 0.5]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]), np.ones(5))
    assert np.all(np.diff(y) >= 0) and y[-1] == 1.0 and y[0] == 0.0


def corpus():
    rnd = random.Random(6)
    bad, words = ["vile", "scum", "Idiot"], [f"w{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(3, 60))]
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(None, None, "x"), (5000, "", "x"), (0, docs[0][1], "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([(i, t, None) for i, t in labels if i % 3] + [(None, 1, 1), (1, None, 1), (77777, 1, 1)], "doc_id long, toxic int, text int")
    got = score(frame, train(frame, marks)).collect()
    truth = dict(labels)
    assert len(got) == 903 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and r.doc_id % 3 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(r.predicted == 0 and r.evidence == [] for r in got if r.doc_id in (None, 5000))
    assert all(len(r.evidence) == 3 for r in held if r.predicted)


def test_no_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in score(docs, train(docs, none)).collect()] == [(0.0, 0)]
    assert score(docs.limit(0), train(docs.limit(0), none)).count() == 0


def test_near_copies_of_one_text_keep_its_words_in_the_model(spark):
    docs, labels = corpus()
    rnd = random.Random(8)
    base = [f"c{k}" for k in range(60)]
    for at, w in ((10, "vile"), (25, "scum"), (40, "Idiot")):
        base[at:at] = [w]
    for k in range(400):
        copy = list(base)
        for at in rnd.sample(range(45, 60), 2):
            copy[at] = f"d{rnd.randint(0, 10_000)}"
        docs.append((2000 + k, " ".join(copy)))
        labels.append((2000 + k, 1))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    got = score(frame, train(frame, marks)).collect()
    truth = dict(labels)
    held = [r for r in got if r.doc_id % 3 == 0 and r.doc_id < 2000]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_scores_against_every_example_and_word(spark):
    """Whole TF-IDF vectors, all examples, and no example of the scored text: worked out with dictionaries."""
    docs, labels = corpus()
    docs, labels = docs[:240], dict(labels[:160])
    docs[7] = (7, docs[10][1])  # a copy of a positive example, labelled 0
    docs += [(900 + i, docs[i][1] + " " + " ".join(f"unseen{k // 2}" for k in range(30 * i))) for i in (1, 50, 165)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = train(frame, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    text_of = dict(docs)
    words = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in docs}
    held = {i: set(w) for i, w in words.items()}
    examples = sorted({(text_of[i], y): i for i, y in sorted(labels.items(), reverse=True)}.values())
    pos, neg = sum(labels[i] for i in examples), sum(1 - labels[i] for i in examples)

    def weight(t):
        df = sum(t in h for h in held.values())
        a, b = (sum(t in held[i] for i in examples if labels[i] == k) for k in (1, 0))
        share = pos / (pos + neg)
        ratio = 2 * ((a * math.log(a / ((a + b) * share)) if a else 0) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
        ratio = 0 if a / pos <= b / neg else ratio
        return (math.log((1 + len(docs)) / (1 + df)) + 1) * (PLAIN + (1 - PLAIN) * ratio**2 / (ratio**2 + HALF**2))

    known = {t: weight(t) for t in set().union(*(held[i] for i in examples))}

    unseen = (math.log((1 + len(docs)) / 2) + 1) * PLAIN

    def vector(i):
        v = {t: (1 + math.log(words[i].count(t))) * known.get(t, unseen) for t in held[i]}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / n for t, x in v.items()}

    vectors = {i: vector(i) for i, _ in docs}
    got = {r.doc_id: r for r in score(frame, model).collect()}
    for i, text in docs:
        sims = [(round(sum(x * vectors[e].get(t, 0) for t, x in vectors[i].items()), 9), e) for e in examples if text_of[e] != text]
        best = sorted((-s, e) for s, e in sims if s > 0)[:NEIGHBOURS]
        w = [1 / (1.05 - min(-s, 1.0)) for s, _ in best]
        raw = (sum(x * labels[e] for x, (_, e) in zip(w, best)) + 0.5 * model.base) / (sum(w) + 0.5)
        assert math.isclose(got[i].score, model.calibrated(raw), abs_tol=1e-6)
        assert got[i].evidence == [e for _, e in best[:3]]
    assert math.isclose(model.base, pos / (pos + neg))


def test_ids_of_strings_and_long_text(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(f"d{i}", t) for i, t in docs] + [("long", " ".join(["w1 w2 scum"] * 300_000))], "doc_id string, text string")
    marks = spark.createDataFrame([(f"d{i}", t) for i, t in labels], "doc_id string, toxic int")
    got = {r.doc_id: r for r in score(frame, train(frame, marks)).collect()}
    assert got["long"].predicted == 1 and all(e.startswith("d") for e in got["long"].evidence)


def test_the_bound_on_bytes_holds(spark):
    docs, labels = corpus()
    model = train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), max_bytes=20_000)
    assert 0 < len(model.ids) < 600


def test_unknown_words_lower_the_similarity(spark):
    docs, labels = corpus()
    many = " ".join(f"unknown{k}" for k in range(5000))
    frame = spark.createDataFrame([*docs, (5000, docs[5][1] + " w1 w1"), (5001, docs[5][1] + " w1 w1 " + many)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score(frame, train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    assert got[5000] >= 0.5 and got[5001] != got[5000]


def test_a_class_of_one_long_text_stays(spark):
    docs = [(1, "scum " * 20_000), *((i, f"w{i} w{i + 1} good") for i in range(2, 60))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i, _ in docs] + [(10_000 + i, 1) for i in range(300)], "doc_id long, toxic int")
    model = train(frame, labels, max_examples=20, max_bytes=300)
    assert set(model.labels.tolist()) == {0, 1} and len(model.ids) < 40
