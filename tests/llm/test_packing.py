import itertools
import random
import zlib

import numpy as np
import pytest

from eventloom.llm.common import tokenizer_path
from eventloom.llm.packing import best_fit_decreasing, cut, exact_fit_decreasing, lower_bound, pack_documents, pack_lengths

PATH = tokenizer_path("byte_bpe_50k.json")


def fewest(lengths, capacity):
    """Bins needed, by trying every assignment."""
    best = len(lengths)
    for k in range(1, len(lengths) + 1):
        for where in itertools.product(range(k), repeat=len(lengths)):
            room = [capacity] * k
            for n, b in zip(lengths, where):
                room[b] -= n
            if min(room) >= 0:
                return k
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bound_and_packing_against_all_assignments(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 10, 16])
    lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 6))]
    true = fewest(lengths, capacity)
    for pack in (best_fit_decreasing, exact_fit_decreasing, pack_lengths):
        bins, offsets, room = pack(np.array(lengths), capacity)
        assert lower_bound(np.array(lengths), capacity) <= true <= len(room)
        for b in range(len(room)):
            spans = sorted((int(o), n) for o, n, x in zip(offsets, lengths, bins) if x == b)
            at = 0
            for o, n in spans:
                assert o == at
                at += n
            assert at == capacity - room[b]


@pytest.mark.parametrize("seed", range(3))
def test_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    for lengths in (rng.integers(1, 1025, 5000), np.minimum(rng.lognormal(5, 1, 5000).astype(int) + 1, 1024)):
        bins, _, room = pack_lengths(lengths, 1024)
        assert len(np.unique(bins)) == len(room) <= 1.003 * lower_bound(lengths, 1024) + 1


def test_cut():
    assert cut(1024, 1024) == [(0, 1024)]
    assert cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_documents(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    texts = ["a b c", "a b c", None, "", "word " * 3000, "x<|endoftext|>y", "été \U0001f600"]
    rows = [(None if i == 1 else i, t, "n") for i, t in enumerate(texts)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    got = pack_documents(docs, PATH, keep_ids=True).collect()
    want = {}
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append(ids)
    for i, all_ids in want.items():
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.piece, r.sequence_id))
        assert sum(r.length for r in mine) == sum(map(len, all_ids))
        for r in mine:
            part = all_ids[0][r.start : r.start + r.length]
            assert r.ids == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r.length <= 1024
    for _, spans in itertools.groupby(sorted((r.sequence_id, r.offset, r.length) for r in got), key=lambda x: x[0]):
        at = 0
        for _, o, n in spans:
            assert o == at
            at += n
        assert at <= 1024


def test_exchange_lowers_bins(spark):
    from eventloom.llm.common import Scratch
    from eventloom.llm.packing import place

    rnd = random.Random(5)
    items = spark.createDataFrame([(i, rnd.randint(200, 700)) for i in range(3000)], "uid long, length long")
    placed, report = place(Scratch(spark, "test"), items, group_pieces=100)
    assert placed.count() == placed.select("uid").distinct().count() == 3000
    assert report["bins"] == sorted(report["bins"], reverse=True) and len(report["bins"]) > 1
    assert report["bound"] <= report["bins"][-1] <= report["bound"] * 1.02 + 1
    assert placed.select("sequence_id").distinct().count() == report["bins"][-1]
    assert placed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
