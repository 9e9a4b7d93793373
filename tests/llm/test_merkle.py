import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventloom.llm.merkle import Subtree, block_root, fold, leaf_hash, manifest, paths, siblings


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(rows, at):
    out = []
    for row in rows[:-1]:
        a = at - at % 3
        out.append(("".join(row[a:at]), "".join(row[at + 1 : a + 3])))
        at //= 3
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 81, 82, 100, 243, 244])
def test_paths_of_a_block(n):
    leaves = [h(str(i)) for i in range(n)]
    rows = levels(leaves)
    for layer in (1, 2, 3):
        assert list(paths(leaves, len(rows) - 1, layer)) == [path(rows, i) for i in range(n)]
    assert block_root(leaves) == rows[-1][0]


def test_a_subtree_keeps_few_nodes():
    leaves = [h(str(i)) for i in range(729)]
    tree = Subtree(leaves, 4, 6, 0)
    for _ in leaves:
        tree.grow()
        assert sum(map(len, tree.runs)) <= 2 * 6 and sum(map(len, tree.nodes)) <= 9 + 3


def brute(rows):
    """By position in rows: leaf, subroot, root, siblings."""

    def leaf(r):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[1], []).append(k)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf(rows[k])))
        trees.append(levels([leaf(rows[k]) for k in groups[g]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for i, g in enumerate(order):
        for p, k in enumerate(groups[g]):
            both = path(trees[i], p) + path(top, i)
            out.append((rows[k][0], leaf(rows[k]), trees[i][-1][0], top[-1][0], "".join(a + b for a, b in both)))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    rnd = random.Random(height)
    sources = [None, "", "a", "é", "zz", "hot"]
    rows = [(rnd.randint(0, 90) if rnd.random() < 0.95 else None, "hot" if rnd.random() < 0.5 else rnd.choice(sources), rnd.choice([None, "en"]), rnd.choice([None, 3]), rnd.choice([None, "", "a\nb", "ü" * 9])) for _ in range(150)]
    got = manifest(table(spark, rows).repartition(7), height=height).withColumns({"folded": fold(F.col("leaf"), F.col("proof")), "beside": siblings(F.col("proof"))}).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.beside) for r in got), key=str) == brute(rows)
    assert all(r.folded == r.root for r in got) and {(r.doc_id, r.source, r.text) for r in got} == {(r[0], r[1], r[4]) for r in rows}


def test_small_and_odd_tables(spark):
    one = manifest(table(spark, [(5, None, None, None, None)])).first()
    assert one.leaf == one.subroot == one.root == h("1:5", "-", "-", "-", "-") and one.proof == []
    assert manifest(table(spark, [])).count() == 0
    long = manifest(table(spark, [(1, "s", "en", 1, "long " * 200_000), (2, "s", "en", 1, "")])).collect()
    assert len({r.root for r in long}) == 1 and all(len(r.proof) == 1 for r in long)
    clash = spark.createDataFrame([("b", "s", "own", "x"), ("a", "s", "own", "x"), ("a", "s", "own", "x")], "name string, `SOURCE` string, `Tree` string, `LEAF` string")
    out = manifest(clash, id="name", group="source", fields=("name", "tree"))
    assert out.columns == ["name", "SOURCE", "Tree", "leaf", "subroot", "root", "proof"]
    assert [(r.name, r.Tree) for r in out.collect()].count(("a", "own")) == 2


def test_changes_are_seen(spark):
    rows = table(spark, [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(40)])
    claimed = {"claimed": lambda col: leaf_hash([col(f) if f != "text" else F.when(col("doc_id") == 7, "other").otherwise(col("text")) for f in ("doc_id", "source", "lang", "n_chars", "text")])}
    out = manifest(rows, also=claimed, height=2)
    assert [r.doc_id for r in out.where(fold(F.col("claimed"), F.col("proof")) != F.col("root")).collect()] == [7]
