"""Every operator and stage over nulls, empty and very long texts, repeated rows, empty tables, ids of strings, and columns whose names clash."""

import pytest

import corpus_pipeline
from eventloom.llm import decontamination, embedding_dedup, html_text, language_id, near_dedup, packing, secret_scan, token_counts, token_files, toxicity
from eventloom.llm.common import shared_dir, tokenizer_path

BPE = tokenizer_path("byte_bpe_50k.json")
#: What operators make, in another case, and names used inside.
CLASHING = "Score PREDICTED Evidence Lang_Pred bits Spans BLOB Matches N_tokens n_Bytes budget_chars N_Chars __text __host __letter c0 t1 hash id component rep Kept n_links"


def clashing(spark, rows, kind, first="doc_id"):
    extra = CLASHING.split()
    schema = f"{first} {kind}, " + ", ".join(f"`{c}` string" for c in extra) + ", text string, lang string"
    return spark.createDataFrame([(i, *(f"own {c}" for c in extra), t, "en") for i, t in rows], schema)


def rows(kind):
    name = (lambda i: i) if kind == "long" else (lambda i: f"n{i}")
    long = "some words are here again and again " * 30_000
    out = [(name(1), "a text of several words, idiot"), (name(1), "a text of several words, idiot"), (name(2), None), (None, "a text of several words, idiot"), (None, None), (name(3), ""), (name(4), long), (name(5), long), (name(6), "!?"), (name(7), "another clean text of some words"), (name(8), "一二三 四五六")]
    return out, name


def tables(spark, kind):
    docs, name = rows(kind)
    labels = spark.createDataFrame([(name(1), 1, 0), (name(7), 0, 1), (name(7), None, 1), (None, 1, 1), (name(99), 1, 1)], f"doc_id {kind}, toxic int, TEXT int")
    bench = spark.createDataFrame([(name(1), "another clean text of some words"), (name(1), "another clean text of some words"), (None, None), (name(2), None), (name(3), "")], f"item_id {kind}, text string")
    return clashing(spark, docs, kind), labels, bench


OPERATORS = {
    1: (lambda d, lab, b: language_id.predict(d, language_id.train(d)), {"lang_pred", "score", "bits"}),
    3: (lambda d, lab, b: token_counts.token_counts(d, BPE, store=True), {"n_bytes", "n_tokens", "budget_chars", "prefix_counts"}),
    4: (lambda d, lab, b: secret_scan.scan(d, secret_scan.scan(d.limit(3))[1])[0], {"blob", "spans"}),
    5: (lambda d, lab, b: html_text.extract(d, url="lang", html="text"), {"text", "n_chars"}),
    9: (lambda d, lab, b: toxicity.score(d, toxicity.train(d, lab)), {"score", "predicted", "evidence"}),
    10: (lambda d, lab, b: decontamination.annotate(d, decontamination.models_for(d, b)), {"matches"}),
}


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("number", sorted(OPERATORS))
def test_passing_columns(spark, tmp_path, number, kind):
    run, made = OPERATORS[number]
    docs, labels, bench = tables(spark, kind)
    out = run(docs, labels, bench)
    assert out.columns == [c for c in docs.columns if c.lower() not in made] + [c for c in out.columns if c in made]
    out.write.parquet(str(tmp_path / "out"))  # no two names may be the same in any case
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 11
    for c in docs.columns:
        if c in CLASHING.split() and c.lower() not in made:
            assert all(r[c] == f"own {c}" for r in got)
    assert run(docs.limit(0), labels, bench).count() == 0
    assert run(docs.limit(0), labels.limit(0), bench.limit(0)).count() == 0
    if number == 9:
        assert {r.score for r in got if r.text in (None, "", "!?")} == {0.0}
    if number == 10:
        assert [(r.doc_id, [m.item for m in r.matches]) for r in got if r.matches] == [(rows(kind)[1](7), [rows(kind)[1](1)])]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_operators_that_return_tables_of_their_own(spark, kind):
    docs, _, _ = tables(spark, kind)
    name = rows(kind)[1]
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert {r[:3] for r in near if r[0] == name(4)} == {(name(4), 7, name(4))} and (name(5), 7, name(4), False) in near and (name(2), 0, name(2), True) in near
    assert (None, 2, name(1), False) in near and (None, 0, None, False) in near
    pieces = packing.pack_documents(docs, BPE).collect()
    assert sorted({r.doc_id for r in pieces if r.doc_id}) == [name(i) for i in range(1, 9)] and sum(r.length for r in pieces if r.doc_id == name(3)) == 1
    files = token_files.write_and_read(docs, BPE).collect()
    assert len(files) == 11 and sorted(r.start for r in files)[0] == 0
    vectors = spark.createDataFrame([(name(1), [1.0, 0.0]), (name(1), [1.0, 0.0]), (name(2), None), (None, [1.0, 0.0]), (None, [0.5, 0.0])], f"vec_id {kind}, embedding array<double>")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert got == {(name(1), 2, name(1), True), (name(2), 0, name(2), True), (None, 2, name(1), False), (None, 0, None, False)}
    for run in (near_dedup.near_duplicates, lambda d: packing.pack_documents(d, BPE), lambda d: token_files.write_and_read(d, BPE)):
        assert run(docs.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_stages(spark, tmp_path, kind):
    docs, labels, bench = tables(spark, kind)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = spark.read.parquet(str(tmp_path / f"{k - 1}")) if k else docs
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{k}"))
        if k < 4:
            assert out.columns == columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = spark.read.parquet(str(tmp_path / "3")).collect()
    name = rows(kind)[1]
    assert {r.doc_id for r in kept} >= {name(2), name(3), name(6), name(8), None} and name(7) not in {r.doc_id for r in kept} and name(5) not in {r.doc_id for r in kept}


def test_a_cluster_must_name_the_shared_folder():
    class Session:
        def __init__(self, master):
            self.values = {"spark.master": master}
            self.conf = self

        def get(self, key, default):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(Session(master))
    assert shared_dir(Session("local[4]"))


def test_stages_keep_different_texts_under_one_id_and_names_that_differ_in_case(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "quite another thing of a benchmark with many words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = ["one text of some words here", "another text that has nothing in common with it", "one text of some words here"]
    docs = spark.createDataFrame([(1, t, len(t), f"own {k}", "own") for k, t in enumerate(texts)] + [(None, texts[0], 1, "own 3", "own")], "doc_id long, text string, n_chars int, DOC_ID string, TEXT string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = sorted(tuple(r) for r in out.collect() if r[0]) if name != "minhash_near_dedup" else None
        if got is None:
            assert sorted((r[0], r[1]) for r in out.collect()) == [(1, texts[1]), (1, texts[0])] or sorted(r[1] for r in out.collect()) == sorted(texts[:2])
        else:
            assert [r[3] for r in got if r[1] == texts[1]] == ["own 1"] and len(got) == 3
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == 4
