import zlib

import numpy as np
import pytest

from eventloom.llm.common import tokenizer_path
from eventloom.llm.token_files import WaveletMatrix, encode_shards, write_and_read, write_matrix, write_shards

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (7, 2), (511, 300), (512, 50257), (513, 70000), (5000, 50257), (300_000, 9)])
def test_matrix_against_array(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
    matrix = WaveletMatrix(write_matrix(ids, np.array([n])))
    assert (matrix.ids() == ids).all() and matrix.lengths.tolist() == [n]
    for i in rng.integers(0, n, 60).tolist() if n else []:
        assert matrix.access(i) == ids[i]
    for token in [*rng.choice(ids, 15).tolist(), top + 1] if n else [0]:
        at = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(at)
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert matrix.count(token, a, b) == ((at >= a) & (at < b)).sum()
        for k in {0, len(at) // 2, len(at) - 1} if len(at) else []:
            assert matrix.locate(token, k) == at[k]
    with pytest.raises(IndexError):
        matrix.locate(top + 1, 0)


def test_segments_are_read_alone():
    ids = np.random.default_rng(1).integers(0, 50257, 2_000_000).astype(np.uint32)
    matrix = WaveletMatrix(write_matrix(ids, np.array([len(ids)])))
    assert matrix.access(1_234_567) == ids[1_234_567]
    assert len(matrix.read) <= 2 * matrix.width < matrix.per_plane * matrix.width
    with pytest.raises(ValueError):
        WaveletMatrix(b"x" * 100)


def want(rows):
    from tokenizers import Tokenizer

    lib, out, at = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark):
    rows = [(97 * k % 1009 - 200, f"text number {k} " * (k % 50)) for k in range(400)] + [(None, None), (5000, ""), (6000, "x<|endoftext|>"), (7000, "word " * 30000)]
    frame = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, start string")
    got = write_and_read(frame, PATH, shard_ids=2000).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want(rows)


def test_repeated_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b")] * 5, "doc_id long, text string")
    assert sorted(r.start for r in write_and_read(frame, PATH).collect()) == [0, 3, 6, 9, 12]
    assert write_and_read(frame.limit(0), PATH).count() == 0


def test_a_file_answers_by_itself(spark, tmp_path):
    rows = [(f"d{k:03}", f"text number {k} " * 300) for k in range(200)]
    write_shards(encode_shards(spark.createDataFrame(rows, "doc_id string, text string").coalesce(1), PATH), str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part=*/shard=*/first=*/n_ids=*/*.txt"))
    assert files and [d for f in files for d in WaveletMatrix.open(str(f)).doc_ids.to_pylist()] == [i for i, _ in rows]
    ids = np.random.default_rng(1).integers(0, 50257, 2_000_000).astype(np.uint32)
    big = tmp_path / "big"
    big.write_bytes(write_matrix(ids, np.array([len(ids)])) + b"\n")
    matrix = WaveletMatrix.open(str(big))
    read, inner = [], matrix._read
    matrix._read = lambda at, n: read.append(n) or inner(at, n)
    assert matrix.access(1_234_567) == ids[1_234_567]
    assert sum(read) < big.stat().st_size / 5


def test_a_repeated_id_is_dealt_to_many_tasks(spark):
    rows = [(None if k % 2 else 7, f"text {k}") for k in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert encode_shards(frame, PATH).select("part").distinct().count() > 2
    got = write_and_read(frame, PATH).collect()
    assert len(got) == 4000 and sorted(r.start for r in got)[-1] == sum(r.n_tokens for r in got) - max(got, key=lambda r: r.start).n_tokens
