import math
import random

import numpy as np
import pytest

from eventloom.llm import language_id
from eventloom.llm.language_id import Model, build, grams, predict, train


def tree(texts, order):
    """context -> byte -> count, for every context of up to ``order`` bytes."""
    out = {}
    for t in texts:
        for i, c in enumerate(t):
            for k in range(order + 1):
                if i >= k:
                    out.setdefault(t[i - k : i], {}).setdefault(c, 0)
                    out[t[i - k : i]][c] += 1
    return out


def bits(text, seen, order):
    """Code length, one byte at a time."""
    total = 0.0
    for i, c in enumerate(text):
        for k in range(min(order, i), -1, -1):
            row = seen.get(text[i - k : i])
            if row is None:
                continue
            n, q = sum(row.values()), len(row)
            if c in row:
                total -= math.log2(row[c] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


@pytest.mark.parametrize("order,table", [(1, None), (2, None), (4, None), (4, 50), (3, 0)])
def test_code_lengths_against_one_byte_at_a_time(monkeypatch, order, table):
    if table is not None:  # levels beyond the bound are searched
        monkeypatch.setattr(language_id, "TABLE", table)
    rnd = random.Random(order)
    make = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))).encode()
    learn = [[make("abc d") for _ in range(20)], [make("bcdé ") for _ in range(20)]]
    counts = []
    for length in range(1, order + 2):
        per = []
        for texts in learn:
            raw = np.frombuffer(b"".join(texts), np.uint8)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            per.append(dict(zip(*(x.tolist() for x in np.unique(grams(raw, starts, length), return_counts=True)))))
        code = np.array(sorted(set().union(*per)), np.int64)
        counts.append((code, np.array([[p.get(int(c), 0) for p in per] for c in code], float)))
    model = build(["x", "y"], counts)
    ask = [make("abcdé zq") for _ in range(50)] + [b"", b"z"]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in ask])])
    got = model.code_lengths(np.frombuffer(b"".join(ask), np.uint8), starts)
    seen = [tree(texts, order) for texts in learn]
    want = np.array([[bits(t, s, order) for s in seen] for t in ask])
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def corpus(spark):
    rnd = random.Random(3)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ße", "ün", "sch", "ka"], "cc": ["th", "ing", "lo", "ea"]}
    rows = []
    for i in range(300):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(rnd.randint(4, 30))), lang, "x"))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(spark)
    odd = [(None, None, "aa", "x"), (1000, "", None, "x"), (1001, "12 !!", "bb", "x"), (1002, "\U0001f600", None, "x"), (1003, "мир", None, "x"), (7, rows[7][1], rows[7][2], "x")]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = train(frame.where("doc_id % 4 <> 2"))
    assert model.languages == ["aa", "bb", "cc"]
    got = predict(frame, model).collect()
    assert len(got) == 306 and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 300)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (None, 1000, 1001, 1002))
    assert by_id[1003].lang_pred in model.languages


def test_nothing_learned(spark):
    frame = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = train(frame)
    assert isinstance(model, Model) and [r.lang_pred for r in predict(frame, model).collect()] == ["und"]
    assert predict(frame.limit(0), model).count() == 0


def test_query_against_trees_of_all_taught_rows(spark):
    import zlib

    from eventloom.llm.queries import op1_language_id

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    taught = [r for r in docs if not held[r.doc_id] and r.lang and r.text is not None]  # all of them, as the table is small
    languages = sorted({r.lang for r in taught})
    seen = [tree([r.text.lower().encode() for r in taught if r.lang == x], 4) for x in languages]
    got = {r.doc_id: r for r in op1_language_id(spark, folder).collect()}
    assert len(got) == len(docs) and all(got[i].held_out == h for i, h in held.items())
    for r in docs:
        text = (r.text or "").lower().encode()
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
        elif len(text) < 1500:
            lengths = [bits(text, s, 4) for s in seen]
            assert got[r.doc_id].lang_pred == languages[int(np.argmin(lengths))]
            assert math.isclose(got[r.doc_id].bits, min(lengths), rel_tol=1e-3)
            assert math.isclose(got[r.doc_id].score, 1 / sum(2 ** max(min(lengths) - x, -1000) for x in lengths), rel_tol=1e-2)


def test_no_language_is_lost(spark):
    rows = [(1, "bonjour le monde tout entier " * 20_000, "fr"), (2, None, "xx"), (3, "", "yy"), *((10 + i, f"the world is round number {i}", "en") for i in range(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, max_bytes=20_000)
    assert model.languages == ["en", "fr"]
    got = {r.doc_id: r.lang_pred for r in predict(spark.createDataFrame([(1, "le monde est entier", "")], "doc_id long, text string, lang string").union(docs.where("doc_id > 380")), model).collect()}
    assert got[1] == "fr" and {v for k, v in got.items() if k > 1} == {"en"}
