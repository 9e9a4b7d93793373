"""Toxicity scores from the nearest labelled examples by TF-IDF cosine.

The examples are a bounded, hash-chosen sample of labelled rows, each with the whole vector of its words. A word weighs
(1 + log of its count) * idf * relevance. Inverse document frequencies are over all documents. The relevance grows
from ``PLAIN`` to 1 with the log-likelihood ratio by which positive examples hold the word more than others do; near
copies of one text count as one example in this. No word is left out: a word that no example holds is in the length of its text's vector, at the weight of a
word of one document that marks nothing. Examples lie in an inverted index in blocks: a word's list has
its runs of postings by block, each with its largest weight, so that lists are followed only in blocks that can reach the k best, which
are still exact. The lists of common words are written out with their zeros and multiplied with many texts at once. Votes of the k nearest, weighted by distance, give a raw score, which a monotone fit
on left-out examples turns into a calibrated one. An example of the very text that is scored is no neighbour of it, in the fit and
after, so that the label of a text doesn't vote on that text.

Defined results: null or empty texts, and texts that share no word with an example, have no neighbour and get the share
of positive labels among examples without words (0 if there are none). Several labels of one id count as positive if any is.
Labels that are null, or of ids not in the documents, are not used. With no usable example all scores are 0.
Ties of similarity go to the smaller example id. Repeated rows are each scored. A very long text is a step of its own, whole, and its worker holds
its words at once. Other columns pass through; an output
column that clashes with one, in any case of letters, replaces it. Ids may be of any type that both tables share; evidence holds long or string ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import NOT_WORD, Columns, Scratch, chunks, held, mix, ranges, text_buffer, tidied, word_hashes

#: Labelled rows of each class that are used, and their bytes of text; the sample is chosen by a hash of the id.
MAX_EXAMPLES, MAX_BYTES = 2000, 64 << 20
#: Neighbours, and the examples in a block of the index.
NEIGHBOURS = 31
BLOCK = 64
#: Of so many rows one must hold a word for its list to be written out, and texts that are compared at once.
DENSE, BATCH = 20, 64
#: Relevance of a word that marks nothing, and the log-likelihood ratio at which relevance is half way to 1.
PLAIN, HALF = 0.1, 20.0
#: Values of an example's sketch of word pairs, and the share of equal ones from which examples are near copies.
SKETCH, COPY = 64, 0.4
#: Words whose frequencies stand in one row.
_TERMS_IN_ROW = 8192


class BlockMaxIndex:
    """Exact k nearest rows by dot product over inverted lists with a largest weight per block.

    Rows are given as sparse vectors: row r has ``terms[at[r]:at[r + 1]]``, ascending, with ``weights`` beside them.
    """

    def __init__(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, width: int, block: int = BLOCK):
        n = len(ids)
        held = np.bincount(terms, minlength=width)
        # rows with the same commonest and leading terms share blocks, which makes the bounds tight
        top = np.full((n, 4), -1, np.int64)
        for r in range(n):
            mine = slice(at[r], at[r + 1])
            if at[r + 1] > at[r]:
                top[r, 0] = terms[mine][np.argmax(held[terms[mine]])]
            lead = terms[mine][np.argsort(-weights[mine], kind="stable")[:3]]
            top[r, 1 : 1 + len(lead)] = lead
        self.order = np.lexsort((np.arange(n), *top.T[::-1])) if n else np.zeros(0, np.int64)
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.ids = np.asarray(ids)[self.order]
        self.n, self.block, self.blocks = n, block, -(-n // block)
        row = place[np.repeat(np.arange(n), np.diff(at))]
        by = np.lexsort((row, terms))
        self.row, self.weight, term = row[by].astype(np.int32), weights[by], terms[by]
        run = self.row // block
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (run[1:] != run[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.run_at, self.run_block = np.append(first, len(term)), run[first].astype(np.int64)
        self.run_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.list_at = np.searchsorted(term[first], np.arange(width + 1))
        # lists of words that one in DENSE rows holds are written out, zeros and all
        common = np.flatnonzero(held > max(1, n // DENSE))
        self.common = np.full(width, -1, np.int64)
        self.common[common] = np.arange(len(common))
        self.full = np.zeros((len(common), self.blocks * block))
        here = self.common[term]
        self.full[here[here >= 0], self.row[here >= 0]] = self.weight[here >= 0]
        self.scored = 0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers as given to the constructor, similarities) of the k best above 0, by similarity and then id, without some rows."""
        return next(self.nearest_of([(terms, weights, without)], k))

    def nearest_of(self, queries: list[tuple], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of several (terms, weights, without). Their common words are multiplied with the written-out lists at once;
        what those leave of the k best bounds the blocks in which the lists of the other words are followed."""
        mine = [self.common[terms] for terms, _, _ in queries]
        dense = np.zeros((len(queries), len(self.full)))
        for q, (number, (_, weights, _)) in enumerate(zip(mine, queries, strict=True)):
            dense[q, number[number >= 0]] = weights[number >= 0]
        scores = dense @ self.full if len(self.full) else np.zeros((len(queries), self.blocks * self.block))
        for found, number, (terms, weights, without) in zip(scores, mine, queries, strict=True):
            if len(without):
                out = np.flatnonzero(np.isin(self.order, without))
            terms, weights = terms[number < 0], weights[number < 0]
            count = self.list_at[terms + 1] - self.list_at[terms]
            runs = ranges(self.list_at[terms], count)
            weight = np.repeat(weights, count)
            where = self.run_block[runs]
            low = found
            if len(without):
                low = found.copy()
                low[out] = 0
            floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else 0.0
            bound = found.reshape(self.blocks, self.block).max(axis=1, initial=0) + np.bincount(where, self.run_most[runs] * weight, minlength=self.blocks)
            at = np.flatnonzero(bound[where] >= floor - 1e-8)
            size = self.run_at[runs[at] + 1] - self.run_at[runs[at]]
            posts = ranges(self.run_at[runs[at]], size)
            self.scored += len(posts)
            found = found + np.bincount(self.row[posts], self.weight[posts] * np.repeat(weight[at], size), minlength=len(found))
            if len(without):
                found[out] = 0
            rows = np.flatnonzero(found[: self.n] > max(0.0, floor - 1e-8))
            sims = found[rows]
            if len(rows) > k:  # the rest can't be among the best, even where rounding makes ties
                near = np.flatnonzero(sims >= np.partition(sims, len(sims) - k)[len(sims) - k] - 2e-9)
                rows, sims = rows[near], sims[near]
            best = np.lexsort((self.ids[rows], -np.round(sims, 9)))[:k]
            yield self.order[rows[best]], sims[best]


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (x, value) of the best non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for k in order.tolist():
        pools.append([x[k], y[k] * w[k], w[k]])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            at, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


@dataclass
class Model:
    """Words, their weights, examples and calibration; its size is bounded by that of the sample."""

    terms: np.ndarray  # sorted hashes
    weight: np.ndarray  # idf * relevance
    ids: np.ndarray
    hashes: np.ndarray  # of the examples' texts
    labels: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # the examples' vectors: where each begins, term numbers, counts
    numbers: np.ndarray
    counts: np.ndarray
    unseen: float = 0.0  # weight of a word that no example holds
    neighbours: int = NEIGHBOURS
    share: float = 0.0
    base: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))

    def __post_init__(self):
        self._index, self._seen = None, {}

    def __getstate__(self):
        return self.__dict__ | {"_index": None, "_seen": {}}

    @property
    def index(self) -> BlockMaxIndex:
        if self._index is None:
            parts = [self.vector(self.numbers[a:b], self.counts[a:b]) for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]
            self._index = BlockMaxIndex(self.at, self.numbers, np.concatenate([np.zeros(0), *parts]), self.ids, len(self.terms))
        return self._index

    def vector(self, numbers: np.ndarray, counts: np.ndarray, rest: float = 0.0) -> np.ndarray:
        """Parts of a text's vector of length 1; ``rest`` is what its words that no example holds add to the square of its length, at weight 1."""
        w = (1 + np.log(counts)) * self.weight[numbers]
        return w / np.sqrt((w * w).sum() + rest * self.unseen**2) if len(w) else w

    def fit(self) -> Model:
        """Calibrates on the examples, each scored without those of its text."""
        if not len(self.ids):
            return self
        filled = np.diff(self.at) > 0
        mean = lambda rows: float((self.weights * self.labels)[rows].sum() / self.weights[rows].sum()) if rows.any() else 0.0
        self.share, self.base = mean(~filled), mean(filled)
        at = np.flatnonzero(filled)
        raw = [self.vote(*found) for found in self._nearest([(self.numbers[self.at[k] : self.at[k + 1]], self.counts[self.at[k] : self.at[k + 1]], int(self.hashes[k]), 0.0) for k in at.tolist()])]
        if len(at):
            self.steps = monotone(np.array(raw), self.labels[at].astype(float), self.weights[at])
        return self

    def _nearest(self, texts: list[tuple[np.ndarray, np.ndarray, int, float]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of each text: its words, their counts, the hash of the text, and what its other words add to the square of its length."""
        for a in range(0, len(texts), BATCH):
            yield from self.index.nearest_of([(numbers, self.vector(numbers, counts, rest), np.flatnonzero(self.hashes == text)) for numbers, counts, text, rest in texts[a : a + BATCH]], self.neighbours)

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        """Distance-weighted share of positive labels; near 0 and 1 it keeps a little of the overall share."""
        w = self.weights[rows] / (1.05 - np.minimum(sims, 1.0))
        prior = 0.5 * self.weights.mean()
        return float((w @ self.labels[rows] + prior * self.base) / (w.sum() + prior))

    def calibrated(self, raw: float) -> float:
        x, y = self.steps
        return float(np.clip(np.interp(raw, x, y), 0.0, 1.0)) if len(x) else self.share

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray, int, float]]) -> list[tuple[float, list]]:
        """Score and the ids of the three nearest examples of each text, given as for ``_nearest``."""
        keys = [(text, numbers.tobytes(), counts.tobytes(), rest) if len(numbers) and len(self.ids) else None for numbers, counts, text, rest in texts]
        new = {key: t for key, t in zip(keys, texts, strict=True) if key is not None and key not in self._seen}
        for key, (rows, sims) in zip(new, self._nearest(list(new.values())), strict=True):
            self._seen[key] = (self.calibrated(self.vote(rows, sims)), self.ids[rows[:3]].tolist()) if len(rows) else (self.share, [])
        out = [(self.share, []) if key is None else self._seen[key] for key in keys]
        if len(self._seen) > 2_000:
            self._seen.clear()
        return out


def term_counts(raw: np.ndarray, starts: np.ndarray, terms: np.ndarray, others: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's words among these sorted hashes begin, their numbers, ascending, and counts; and, if asked, each text's sum of
    (1 + log of the count) squared over its other words."""
    words, bounds = word_hashes(raw, starts, NOT_WORD)
    n = len(starts) - 1
    rest = np.zeros(n)
    if not len(terms) or not len(words):
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), rest
    at = np.searchsorted(terms, words)
    at[at == len(terms)] = 0
    same = terms[at] == words
    hit = np.flatnonzero(same)
    if others and len(hit) < len(words):
        miss = np.flatnonzero(~same)
        doc, word = np.searchsorted(bounds, miss, "right") - 1, words[miss]
        by = np.lexsort((word, doc))
        doc, word = doc[by], word[by]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]))
        rest = np.bincount(doc[first], (1 + np.log(np.diff(first, append=len(doc)))) ** 2, minlength=n)
    key = (np.searchsorted(bounds, hit, "right") - 1) * len(terms) + at[hit]
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    doc, number = np.divmod(key[first], len(terms))
    return np.searchsorted(doc, np.arange(n + 1)), number, np.diff(first, append=len(key)), rest


def sketch(words: np.ndarray) -> np.ndarray:
    """The least values of a text's word pairs under SKETCH hashes."""
    if not len(words):
        return np.zeros(SKETCH, np.uint32)
    pairs = np.unique(mix(words[:-1]) + words[1:] if len(words) > 1 else words)
    return np.array([mix(pairs ^ seed).min() >> np.uint64(32) for seed in _SEEDS], np.uint32)


_SEEDS = np.random.default_rng(7).integers(1, 2**63, SKETCH, dtype=np.uint64)


def copy_groups(sketches: np.ndarray) -> np.ndarray:
    """The group of each example: those that near copies join, directly or through others."""
    n = len(sketches)
    group = np.arange(n)
    for a in range(n - 1):
        near = a + 1 + np.flatnonzero((sketches[a + 1 :] == sketches[a]).mean(axis=1) >= COPY)
        near = near[group[near] != group[a]]
        if len(near):
            joined = np.unique(group[np.append(near, a)])
            group[np.isin(group, joined)] = joined[0]
    return group


def _words(examples: DataFrame, kind: str) -> DataFrame:
    """id, label, hash of the text, sketch, and the hashes and counts of the words of every example."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = word_hashes(*text_buffer(batch.column(3)), NOT_WORD)
            mine = [words[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            counted = [np.unique(w, return_counts=True) for w in mine]
            columns = [[sketch(w).tobytes() for w in mine], [t.tobytes() for t, _ in counted], [n.astype(np.int32).tobytes() for _, n in counted]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.binary()) for c in columns)], names=["id", "label", "hash", "sketch", "terms", "counts"])

    return examples.mapInArrow(tidied(split), f"id {kind}, label int, hash long, sketch binary, terms binary, counts binary")


def relevance(terms: np.ndarray, labels: np.ndarray, groups: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For each term number, PLAIN to 1 by the log-likelihood ratio with which groups of positive examples hold it more often."""
    n = {k: max(len(np.unique(groups[labels == k])), 1) for k in (0, 1)}
    row = np.repeat(np.arange(len(labels)), np.diff(at))
    held = np.unique(np.stack([terms, labels[row], groups[row]]), axis=1) if len(terms) else np.zeros((3, 0), np.int64)
    a, b = (np.bincount(held[0][held[1] == k], minlength=width).astype(float) for k in (1, 0))
    part = lambda x, share: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum((a + b) * share, 1e-9)), 0.0)
    ratio = 2 * (part(a, n[1] / (n[0] + n[1])) + part(b, n[0] / (n[0] + n[1])))
    ratio[a / n[1] <= b / n[0]] = 0.0
    return PLAIN + (1 - PLAIN) * ratio**2 / (ratio**2 + HALF**2)


def frequencies(docs: DataFrame, text: str, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Documents, and documents that hold each term; over all of them. Tasks send their counts as rows of many terms, which are added up before the driver gets them."""
    width = len(terms)
    parts = -(-width // _TERMS_IN_ROW)
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # of the bounded sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(parts * _TERMS_IN_ROW, np.int64)
        terms = held(shared, "words")
        for batch in batches:
            raw, starts = text_buffer(batch.column(0))
            n += batch.num_rows
            for a, b in chunks(starts):
                df += np.bincount(term_counts(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a], terms)[1], minlength=len(df))
        blobs = [df[k * _TERMS_IN_ROW : (k + 1) * _TERMS_IN_ROW].astype("<i8").tobytes() for k in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(parts)], pa.int32()), pa.array([n, *[0] * parts], pa.int64()), pa.array([b"", *blobs], pa.binary())], names=["part", "n", "df"])

    def add(table):
        total = sum((np.frombuffer(x.as_buffer(), "<i8") for x in table.column("df") if len(x.as_buffer())), np.zeros(1, np.int64))
        return pa.table({"part": table.column("part")[:1], "n": pa.array([pc.sum(table.column("n")).as_py()], pa.int64()), "df": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    schema, found = "part int, n long, df binary", np.zeros(parts * _TERMS_IN_ROW, np.int64)
    documents = 0
    for r in Columns(docs).frame.select(Columns(docs).text(text)).mapInArrow(tidied(count), schema).groupBy("part").applyInArrow(add, schema).collect():
        if r["part"] < 0:
            documents = r["n"]
        else:
            found[r["part"] * _TERMS_IN_ROW : (r["part"] + 1) * _TERMS_IN_ROW] = np.frombuffer(r["df"], "<i8")
    return documents, found[:width]


def _drawn(rows: DataFrame, id: str, seed: int, size: F.Column, most: int) -> tuple[DataFrame, dict[int, int]]:
    """Of each label rows of a total size of about ``most``, chosen by a hash of the id, and one at least; and each label's whole size."""
    part = F.pmod(F.xxhash64(F.col(id), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    total = {r["label"]: r for r in rows.groupBy("label").agg(F.sum(size).alias("n"), F.min(part).alias("least")).collect()}
    if any(r["n"] > most for r in total.values()):
        bound = F.create_map(*[F.lit(x) for k, r in total.items() for x in (k, max(r["least"], min(1.0, most / max(r["n"], 1))))])
        rows = rows.where(part <= bound[F.col("label")])
    return rows, {k: r["n"] for k, r in total.items()}


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES) -> Model:
    """The model from the documents and the labels given; leave held-out labels out of ``labels``."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    source, given = Columns(docs), Columns(labels)
    kind = source.id_type(id)
    marks = given.frame.select(given.col(id).cast(kind).alias("id"), given.col(label).alias("label")).where("id is not null and label is not null")
    marks = marks.groupBy("id").agg(F.max(F.when(F.col("label") > 0, 1).otherwise(0)).cast("int").alias("label"))
    texts = source.frame.select(source.col(id).cast(kind).alias("id"), source.text(text).alias("text")).where("text is not null")
    marks = marks.join(texts.select("id"), "id", "left_semi")
    marks, total = _drawn(marks, "id", 11, F.lit(1), max_examples)
    if marks.count() <= 3 * max_examples:  # the rates keep about 2 * max_examples ids
        marks = F.broadcast(marks)
    chosen = texts.join(marks, "id")
    # one example of each text and label
    chosen = chosen.groupBy(F.xxhash64("text").alias("hash"), "label").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    examples = scratch.save(chosen.select("id", "label", "hash", "text"), "examples")
    examples, _ = _drawn(examples, "id", 13, F.octet_length("text"), max_bytes)
    rows = _words(examples, kind).orderBy("id", "label", "hash").collect()  # bounded by max_examples and max_bytes
    scratch.drop("examples")
    marked = np.array([r["label"] for r in rows], np.int64)
    words = [np.frombuffer(r["terms"], np.uint64) for r in rows]
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    numbers = np.searchsorted(terms, np.concatenate([np.zeros(0, np.uint64), *words])).astype(np.int64)
    counts = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r["counts"], np.int32) for r in rows)]).astype(np.int64)
    groups = np.zeros(len(rows), np.int64)
    for k in (0, 1):
        mine = np.flatnonzero(marked == k)
        if len(mine):
            groups[mine] = copy_groups(np.stack([np.frombuffer(rows[r]["sketch"], np.uint32) for r in mine.tolist()]))
    documents, df = frequencies(docs, text, terms)
    weight = (np.log((1 + documents) / (1 + df)) + 1) * relevance(numbers, marked, groups, at, len(terms))
    n = np.bincount(marked, minlength=2)
    each = np.array([total[m] / n[m] for m in marked.tolist()])
    ids = np.array([r["id"] for r in rows], np.int64 if kind == "long" else object)
    return Model(terms, weight, ids, np.array([r["hash"] for r in rows], np.int64), marked, each / each.mean() if len(rows) else each, at, numbers, counts, (np.log((1 + documents) / 2) + 1) * PLAIN).fit()


def score(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The columns with score, predicted (1 from a score of 0.5) and evidence, the ids of the nearest examples."""
    source = Columns(docs, columns, ("score", "predicted", "evidence"))
    strings = model.ids.dtype == object
    schema = source.schema(("score", "double"), ("predicted", "integer"), ("evidence", T.ArrayType(T.StringType() if strings else T.LongType())))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the bounded sample
    kind = pa.list_(pa.string() if strings else pa.int64())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(shared, "toxicity")
        for batch in batches:
            raw, starts = text_buffer(batch.column(batch.num_columns - 1))
            hashes = batch.column(batch.num_columns - 2).to_pylist()
            found = []
            for a, b in chunks(starts):
                at, numbers, counts, rest = term_counts(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a], model.terms, others=True)
                found += model.scores([(numbers[x:y], counts[x:y], h, r) for x, y, h, r in zip(at[:-1].tolist(), at[1:].tolist(), hashes[a:b], rest.tolist(), strict=True)])
            made = [pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array([e for _, e in found], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=schema.names)

    words = source.text(text)
    return source.named(source.frame.select(*source.passing(), F.xxhash64(words).alias("hash"), words.alias("text")).mapInArrow(tidied(apply), schema))
