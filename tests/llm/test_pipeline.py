import random
import re

import corpus_pipeline
from eventloom.llm.common import tokenizer_path


def planted(rnd):
    """Documents with a known fate."""
    rare = [f"r{k}x" for k in range(4000)]
    text = lambda n: [rnd.choice(rare) for _ in range(n)]
    bad = ["vile", "scum", "moron"]
    items = {k: " ".join(text(30)) for k in range(5)}
    docs, toxic, leaked, copies, secret, labels = [], set(), set(), {}, {}, []
    for i in range(400):
        words = text(rnd.randint(20, 120))
        if i % 10 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
            toxic.add(i)
        elif i % 10 == 1:
            words[5:5] = items[rnd.choice(list(items))].split()
            leaked.add(i)
        elif i % 10 == 2 and i > 20:
            of = i - 19  # a clean document
            words = docs[of][1].split()
            if i % 20 == 2:
                words[len(words) // 2] = "changed"
            if len(set(zip(*(words[k:] for k in range(5))))) >= 45 or i % 20 != 2:
                copies[i] = of
        elif i % 10 == 3 and i < 350:
            words.insert(3, "password=hunter2hunter2")
            secret[i] = True
        docs.append((i, " ".join(words), "en", "s", 0, "own"))
        labels.append((i, 1, int(i in toxic)))
    return docs, items, toxic, leaked, copies, secret, labels


def test_stages_against_planted(spark, tmp_path):
    docs, items, toxic, leaked, copies, secret, labels = planted(random.Random(1))
    docs += [(None, None, None, None, None, "own"), (900, "", "en", "s", 0, "own"), (901, None, "en", "s", 0, "own"), (3, docs[3][1], "en", "s", 0, "own")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = frame.columns, {i for i, *_ in docs}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        assert frame.columns == columns
        rows = frame.collect()
        seen[name] = {r.doc_id for r in rows}
        assert all(r.score == "own" for r in rows)
    assert seen["toxicity"] == kept - toxic
    assert seen["minhash_near_dedup"] == kept - toxic - set(copies)
    assert len([r for r in rows if r.doc_id == 3]) == 1
    assert seen["benchmark_decontamination"] == seen["secret_scans"] == kept - toxic - set(copies) - leaked
    by_id = {r.doc_id: r for r in rows}
    for i in secret:
        if i in by_id:
            assert "hunter2" not in by_id[i].text and " [assign] " in by_id[i].text and by_id[i].n_chars == len(by_id[i].text)
    for i in seen["secret_scans"] - set(secret) - {None, 900, 901}:
        assert by_id[i].text == docs[i][1] or "hunter2" in docs[i][1]
    # the last stage, against the tokenizer and the capacity
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    length = {}
    for r in packed:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows}
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 2
    assert not re.search("hunter2", " ".join(r.text or "" for r in rows))


def test_empty_documents(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
