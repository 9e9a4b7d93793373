import random
import re

import numpy as np
import pytest

from eventloom.llm.common import text_buffer
from eventloom.llm.near_dedup import estimate, near_duplicates, registers, shingle_sets
import pyarrow as pa

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text, size):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "B", "été", "word", "x1", "The", "of", " ", "y."]
    texts = []
    for n in (0, 1, 2, 3, 4, 5, 8, 20, 60, 200):
        base = [rnd.choice(vocabulary) + str(rnd.randint(0, 40)) for _ in range(n)]
        texts += [" ".join(base), "\t".join(base).upper()]
        for edits in (1, 2, 3, 5, 8, 13, 20):
            copy = list(base)
            for _ in range(edits if n else 0):
                copy[rnd.randrange(n)] = rnd.choice(vocabulary) + str(rnd.randint(0, 40))
            texts.append("\n".join(copy))
    texts += ["", " \n", "a a a a a a a", "a a a a"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size,percent,seed", [(3, 85, 1), (5, 80, 2)])
def test_against_brute_force(spark, size, percent, seed):
    rows = corpus(seed)
    got = near_duplicates(spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string"), size=size, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, size, percent)


def test_chain_and_large_group(spark):
    """A chain of small edits is one component, however unlike its ends are; so is a large family."""
    rnd = random.Random(3)
    text = [f"w{rnd.randint(0, 9999)}" for _ in range(120)]
    rows, at = [], 0
    for k in range(60):
        rows.append((1000 - k, " ".join(text)))
        text[at] = f"n{k}"
        at = (at + 2) % 120
    base = [f"v{k}" for k in range(100)]
    for k in range(700):
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(100)] = f"z{rnd.randint(0, 99)}"
        rows.append((2000 + k, " ".join(copy)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 3, 85)


def test_nulls_and_repeats(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, None), (None, "only here now"), (9, "a b c d")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert sorted(map(str, got)) == sorted(
        [
            "Row(doc_id=5, n_shingles=2, component_id=5, kept=True)",
            "Row(doc_id=5, n_shingles=2, component_id=5, kept=True)",
            "Row(doc_id=None, n_shingles=2, component_id=5, kept=False)",
            "Row(doc_id=7, n_shingles=0, component_id=7, kept=True)",
            "Row(doc_id=None, n_shingles=1, component_id=None, kept=False)",
            "Row(doc_id=9, n_shingles=2, component_id=5, kept=False)",
        ]
    )
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate():
    rnd = random.Random(4)
    for shared in (200, 600, 900):
        a = [f"s{k}" for k in range(1000)]
        b = a[:shared] + [f"t{k}" for k in range(1000 - shared)]
        rnd.shuffle(a), rnd.shuffle(b)
        raw, starts = text_buffer(pa.array([" ".join(a), " ".join(b)]))
        hashes, at = shingle_sets(raw, starts, 1)
        sig = registers(hashes, at)
        true = shared / (2000 - shared)
        assert abs(estimate(sig[:1], sig[1:], np.array([1000]), np.array([1000]))[0] - true) < 0.15
