import random
import time

import pytest

from eventloom.llm.bpe import Encoder
from eventloom.llm.common import tokenizer_path
from eventloom.llm.token_counts import pack_counts, prefix_table, token_counts, truncated, unpack_counts

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = ["a   b", "I'll we're they've  x \n\n y  ", "  ", "", "don't 'r 'll", "x<|endoftext|>y <|endof", "你好  \U0001f600 á", "\x1c\x1d a\x85b", "ſK straße １２ ²³", "É  x"]


@pytest.mark.parametrize("text", ODD)
def test_every_prefix(text):
    table, lib = prefix_table(PATH), Encoder(PATH).library
    counts = table.prefix_counts(text)
    assert counts.tolist() == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert (unpack_counts(pack_counts(counts)) == counts).all()


def test_random_texts_and_budget():
    table, lib, rnd = prefix_table(PATH), Encoder(PATH).library, random.Random(1)
    for _ in range(60):
        text = "".join(rnd.choice("the an'd ing éß  \n12!x你好м\u2003🙂") for _ in range(rnd.randint(0, 300)))
        limit = rnd.randint(1, 80)
        ((n, chars, counts),) = table.stats([text], limit)
        assert n == len(lib.encode(text, add_special_tokens=False).ids)
        assert counts.tolist() == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert truncated(counts, limit) == chars == max(i for i, c in enumerate(counts) if c <= limit)


def test_table(spark):
    rows = [(1, "hello world", "x"), (None, None, None), (1, "hello world", "x"), (3, "", "y"), (4, "word " * 5000, "z")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, store=True).collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == [(1, 11, 2), (None, 0, 0), (1, 11, 2), (3, 0, 0), (4, 25000, 5001)]
    assert unpack_counts(got[0].prefix_counts)[-1] == 2
    assert got[4].budget_chars < 25000
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("unit", ["天地玄黃宇宙洪荒", "supercalifragilistic", "=-", "мирутрудмай", "a b  c你 "])
def test_a_megabyte_takes_seconds(unit):
    rnd, table, lib = random.Random(4), prefix_table(PATH), Encoder(PATH).library
    text = "".join(rnd.choice(unit) for _ in range(1_000_000 // len(unit[0].encode())))
    started = time.monotonic()
    counts = table.prefix_counts(text)
    assert time.monotonic() - started < 30
    for end in (len(text), 1000, 31_415):
        assert counts[end] == len(lib.encode(text[:end], add_special_tokens=False).ids)


def test_query_against_the_library(spark):
    from eventloom.llm.queries import op3_token_counts

    folder = "/root/testdata/sf0.001"
    lib, texts = Encoder(PATH).library, {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op3_token_counts(spark, folder).collect():
        n = len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)
        counts = unpack_counts(r.prefix_counts)
        half = len(texts[r.doc_id]) // 2
        assert len(counts) == len(texts[r.doc_id]) + 1 and counts[half] == len(lib.encode(texts[r.doc_id][:half], add_special_tokens=False).ids)
