import hashlib
import random
import re

import pytest

from eventloom.llm.exact_dedup import Delivery, DigestIndex, exact_duplicates

SCHEMA = "doc_id long, text string"


def texts(n=300):
    rnd = random.Random(5)
    return [(i, rnd.choice([None, "", " \n", "a b", "ab", " a\x0bb", "hot text", "hot  text", "hot\ttext\r\n", "é x", "éx", "x" * 40_000])) for i in range(n)]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[plain])[1]
        out.append((i, keep, len(groups[plain]), keep == i, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out)


def taken(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_one_delivery(spark):
    assert taken(exact_duplicates(spark.createDataFrame(texts(), SCHEMA))) == brute(texts())


def test_deliveries_equal_one_and_outlive_the_session(spark, tmp_path):
    rows, path = texts(), f"file://{tmp_path}/index"
    parts = [rows[0::3], rows[1::3], [*rows[2::3], (1000, "fresh")]]
    for k, part in enumerate(parts):
        # each opens the index under a name of its own, as another session does
        out = exact_duplicates(spark.createDataFrame(part, SCHEMA), path, f"day {k}")
        so_far = brute([r for p in parts[: k + 1] for r in p])
        assert taken(out) == [r for r in so_far if r[0] in {i for i, _ in part}]
    index = DigestIndex(spark, path)
    assert index.buckets == 8
    before = sorted(map(str, index.entries().collect()))
    again = Delivery(spark.createDataFrame(parts[1], SCHEMA), "day 1")
    index.add(again.rows, "day 1")  # delivered already: adds nothing
    assert sorted(map(str, index.entries().collect())) == before
    whole = Delivery(spark.createDataFrame(parts[0], SCHEMA), "day 0")
    assert taken(index.decide(whole)) == [r for r in brute([r for p in parts for r in p]) if r[0] in {i for i, _ in parts[0]}]
    firsts = index.entries().where("first").groupBy("digest").count().where("count > 1").count()
    index.close()
    assert firsts == 0


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    rows = Delivery(spark.createDataFrame(texts(), SCHEMA), "a")
    index.add(rows.rows, "a")
    own = rows.rows.groupBy("digest").count()
    plan = own.join(index.entries().where("first").select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert "Exchange" not in index.groups()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    index.close()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_tables(spark, kind):
    name = (lambda i: i) if kind == "long" else (lambda i: f"n{i}")
    schema = f"doc_id {kind}, `Kept` string, `DIGEST` string, row string, text string"
    rows = [(name(1), "own", "own", "own", "same"), (name(1), "own", "own", "own", "same"), (None, "own", "own", "own", "same"), (None, "own", "own", "own", "alone"), (name(2), "own", "own", "own", None)]
    out = exact_duplicates(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "DIGEST", "row", "text", "keep_id", "group_size", "kept", "text_sha256"]
    got = out.collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == sorted(
        [(str(name(1)), str(name(1)), 3, True), (str(name(1)), str(name(1)), 3, False), ("None", str(name(1)), 3, False), ("None", "None", 1, True), (str(name(2)), str(name(2)), 1, True)]
    )
    assert all(r.DIGEST == "own" and r.row == "own" for r in got)
    assert exact_duplicates(spark.createDataFrame([], schema)).count() == 0
