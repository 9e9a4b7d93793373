"""Benchmark decontamination by latent semantic retrieval.

Documents and items are cut into passages of words, weighted by TF-IDF with frequencies over all
documents. The terms are all words of the items, so
the matrix has as many columns as the benchmark needs however large the corpus is. A pass over the
corpus multiplies its Gram matrix with a random one, and the Nystrom form of the randomised SVD gives the
latent axes of passages and items, in which the items weigh as much as the corpus. Another pass takes
passages whose latent cosine with an item reaches a low threshold, and confirms them: the longest
common subsequence of words, in the passage and its surroundings, must cover most of the item, and the
item's answer part must be covered too unless nearly everything is. Items of few words, which are a small part of any passage,
are found as whole word sequences besides.

Windows of items are taken in blocks of at most ``WINDOWS``. The latent space of a block is that of the corpus's ``AXES`` leading axes and of its
windows together, so that every window keeps its length. Frequencies of all blocks
are counted in one pass, ``TOGETHER`` blocks are multiplied in one, and one pass searches for all items; a task holds the sums of ``TOGETHER`` blocks, or
the axes of one. The driver sees items, term frequencies and the latent axes, never documents.

Defined results: null or empty texts match nothing; items without a word, and null items, match nothing. An item of one word is found wherever
that word is. Items without an id are reported with a null one.
Repeated documents are each matched; of repeated item ids each is reported once a document. A very long document is a step of its own, whole.
Ids may be of any type; items' ids come out as long or string. Columns pass through; an output column that clashes with
an input column, in any case of letters, replaces it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import NOT_WORD, Columns, chunks, held, mix, ranges, released, text_buffer, tidied, word_hashes

#: Words of a tile; a passage is two tiles, and the next one starts a tile later.
TILE = 32
#: Items longer than this are matched in windows of two tiles, and a document that holds one of them holds the item.
WHOLE = 80
#: Items of fewer words have no window; items of up to SHORT words are found as whole word sequences.
MIN_WORDS, SHORT = 5, 12
#: Windows of a block, its axes besides, and blocks multiplied in one pass.
WINDOWS, AXES, SPARE, TOGETHER = 256, 64, 16, 16
#: What the windows of a block weigh together, as a multiple of the corpus.
WEIGHT = 4.0
#: Cosine for a candidate; shares of words that confirm it.
COSINE, COVERED, ANSWER, NEARLY_ALL = 0.3, 0.7, 0.5, 0.9
_TERMS_IN_ROW = 64


@dataclass
class Window:
    """A stretch of the words of an item (its number), as hashes, and where its answer part begins."""

    item: int
    words: np.ndarray
    answer: int


def words_of(text: str) -> np.ndarray:
    raw, starts = text_buffer(pc.utf8_lower(pa.array([text or ""])))
    return word_hashes(raw, starts, NOT_WORD)[0]


_ANSWER = re.compile(r"(?is).*\b(?:answer|solution)\s*[:=]")
_SENTENCE = re.compile(r"(?s).*[.?!\n](?=\s*\S)")


def windows(item: int, text: str | None) -> list[Window]:
    """The stretches of an item that are searched for. Its answer is what follows an answer mark, or else the last sentence."""
    words = words_of(text or "")
    n = len(words)
    if n < MIN_WORDS:
        return []
    mark = _ANSWER.match(text) or _SENTENCE.match(text)
    answer = len(words_of(text[: mark.end()])) if mark else 0
    if not 0 < answer < n or n - answer < 3:
        answer = n - max(3, n // 5)
    if n <= WHOLE:
        return [Window(item, words, answer)]
    size = 2 * TILE
    starts = [*range(0, n - size, size * 3 // 4), n - size]
    return [Window(item, words[a : a + size], max(0, min(answer - a, size - size // 5))) for a in starts]


def common_subsequence(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence with a word list given as word: bits of its places."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


# ------------------------------------------------------------- sparse passages
def places(words: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are among these sorted terms, and which term each is. Most others fail on 16 of their bits."""
    maybe = np.zeros(1 << 16, bool)
    maybe[(terms >> np.uint64(48)).astype(np.int64)] = True
    hit = np.flatnonzero(maybe[(words >> np.uint64(48)).astype(np.int64)])
    at = np.searchsorted(terms, words[hit])
    at[at == len(terms)] = 0
    found = terms[at] == words[hit]
    return hit[found], at[found]


def tile_terms(words: np.ndarray, bounds: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First tile of each text, and tile, term and count of every non-zero."""
    tiles = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // TILE))])
    none = np.zeros(0, np.int64)
    if not len(words) or not len(terms):
        return tiles, none, none, none
    hit, at = places(words, terms)
    if not len(hit):
        return tiles, none, none, none
    doc = np.searchsorted(bounds, hit, "right") - 1
    tile = tiles[doc] + (hit - bounds[doc]) // TILE
    key = tile * len(terms) + at
    if tiles[-1] * len(terms) < 1 << 31:
        key = key.astype(np.int32)  # sorts faster
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(first, append=len(key))
    tile, term = np.divmod(key[first].astype(np.int64), len(terms))
    return tiles, tile, term, count


def _grouped(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of consecutive rows of equal group, and the groups."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.add.reduceat(values, first, axis=0), groups[first]


def _unit(tile: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights with every tile scaled to length 1."""
    square, groups = _grouped(weight * weight, tile)
    return weight / np.sqrt(square)[np.searchsorted(groups, tile)]


def _lowered(batch_text: pa.Array):
    return text_buffer(pc.utf8_lower(batch_text))


def _text(docs: DataFrame, text: str) -> DataFrame:
    given = Columns(docs)
    return given.frame.select(given.text(text))


def _words(raw: np.ndarray, starts: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: (first, end, word hashes, first word of each text)."""
    for a, b in chunks(starts, limit):
        yield a, b, *word_hashes(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a], NOT_WORD)


def tile_frequencies(docs: DataFrame, text: str, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Tiles of all documents, and tiles that hold each term. Tasks' counts are added up before the driver gets them, as rows of many terms."""
    width = len(terms)
    size = max(1, _TERMS_IN_ROW * 64)
    parts = -(-width // size)
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # words of the benchmark

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(parts * size, np.int64)
        terms = held(shared, "words")
        for batch in batches:
            for _, _, words, bounds in _words(*_lowered(batch.column(0)), 1 << 19):
                tiles, _, term, _ = tile_terms(words, bounds, terms)
                n += int(tiles[-1])
                df += np.bincount(term, minlength=len(df))
        blobs = [df[k * size : (k + 1) * size].astype("<i8").tobytes() for k in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(parts)], pa.int32()), pa.array([n, *[0] * parts], pa.int64()), pa.array([b"", *blobs], pa.binary())], names=["part", "n", "sums"])

    found, n = np.zeros(parts * size, np.int64), 0
    for r in _added(_text(docs, text).mapInArrow(tidied(count), "part int, n long, sums binary"), "<i8"):
        if r["part"] < 0:
            n = r["n"]
        else:
            found[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["sums"], "<i8")
    return n, found[:width]


def _added(rows: DataFrame, kind: str) -> list:
    """Rows (part, n, sums) added up by part."""

    def add(table):
        total = sum((np.frombuffer(x.as_buffer(), kind).astype(np.float64 if kind == "<f4" else kind) for x in table.column("sums") if len(x.as_buffer())), np.zeros(1))
        return pa.table({"part": table.column("part")[:1], "n": pa.array([pc.sum(table.column("n")).as_py()], pa.int64()), "sums": pa.array([total.astype(kind).tobytes()], pa.binary())})

    return rows.groupBy("part").applyInArrow(add, "part int, n long, sums binary").collect()


@dataclass
class Block:
    """Windows, their terms, and idf."""

    windows: list[Window]
    terms: np.ndarray
    idf: np.ndarray

    @property
    def columns(self) -> int:
        return min(AXES + SPARE, len(self.terms))

    def omega(self) -> np.ndarray:
        """The random matrix; that of unity where it would be no smaller."""
        if len(self.terms) <= AXES + SPARE:
            return np.eye(len(self.terms), dtype=np.float32)
        return np.random.default_rng(1).standard_normal((len(self.terms), self.columns), np.float32)

    def rows(self) -> np.ndarray:
        """Unit TF-IDF rows of the windows."""
        out = np.zeros((len(self.windows), len(self.terms)))
        for k, w in enumerate(self.windows):
            np.add.at(out[k], np.searchsorted(self.terms, w.words), 1)
        out *= self.idf
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def gram_times(docs: DataFrame, text: str, blocks: list[Block]) -> tuple[list[np.ndarray], int]:
    """For each block A'A times its random matrix, for the unit TF-IDF rows A of all tiles, and the number of tiles with a term of the first.

    Tasks send their sums in rows of some terms each, which are added up before the driver gets them.
    """
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(b) for b in blocks]  # TOGETHER at most
    shapes = [(-(-len(b.terms) // _TERMS_IN_ROW), b.columns) for b in blocks]
    first = np.concatenate([[0], np.cumsum([parts for parts, _ in shapes])])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [b.value for b in shared]
        released(shared)
        omegas = [b.omega() for b in mine]
        sums, rows = [np.zeros((parts * _TERMS_IN_ROW, rank), np.float32) for parts, rank in shapes], 0
        for batch in batches:
            for _, _, words, bounds in _words(*_lowered(batch.column(0)), 1 << 19):
                for k, (block, omega, out) in enumerate(zip(mine, omegas, sums, strict=True)):
                    _, tile, term, count = tile_terms(words, bounds, block.terms)
                    if not len(tile):
                        continue
                    weight = _unit(tile, count * block.idf[term]).astype(np.float32)
                    cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
                    rows += len(cuts) if k == 0 else 0
                    for a in range(0, len(cuts), 1024):  # dense rows of so many tiles at once
                        lo, hi = cuts[a], cuts[a + 1024] if a + 1024 < len(cuts) else len(tile)
                        w, t = weight[lo:hi], term[lo:hi]
                        product, groups = _grouped(omega[t] * w[:, None], tile[lo:hi])
                        order = np.argsort(t, kind="stable")
                        back = product[np.searchsorted(groups, tile[lo:hi][order])]
                        back *= w[order][:, None]
                        part, at = _grouped(back, t[order])
                        out[at] += part
        number, blobs = [-1], [b""]
        for k, out in enumerate(sums):
            shares = out.reshape(shapes[k][0], -1)
            filled = np.flatnonzero(shares.any(axis=1))
            number += (first[k] + filled).tolist()
            blobs += [shares[x].astype("<f4").tobytes() for x in filled]
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([rows, *[0] * (len(number) - 1)], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "n", "sums"])

    results, n = [np.zeros((parts * _TERMS_IN_ROW, rank)) for parts, rank in shapes], 0
    for r in _added(_text(docs, text).mapInArrow(tidied(multiply), "part int, n long, sums binary"), "<f4"):
        if r["part"] < 0:
            n = r["n"]
        else:
            k = int(np.searchsorted(first, r["part"], "right")) - 1
            at = (r["part"] - int(first[k])) * _TERMS_IN_ROW
            results[k][at : at + _TERMS_IN_ROW] = np.frombuffer(r["sums"], "<f4").reshape(_TERMS_IN_ROW, -1)
    return [x[: len(b.terms)] for x, b in zip(results, blocks, strict=True)], n


def axes(product: np.ndarray, omega: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvectors and eigenvalues of a positive semi-definite matrix, from its product with ``omega`` (Nystrom)."""
    shift = 1e-9 * max(np.linalg.norm(product), 1e-12)
    y = product + shift * omega
    small = omega.T @ y
    w, v = np.linalg.eigh((small + small.T) / 2)
    keep = w > w.max() * 1e-12
    u, s, _ = np.linalg.svd(y @ (v[:, keep] / np.sqrt(w[keep])), full_matrices=False)
    return u[:, :rank], s[:rank] ** 2


def latent_space(corpus: tuple[np.ndarray, np.ndarray], rows: np.ndarray, weight: float) -> np.ndarray:
    """Axes (term, axis) of the corpus's leading axes and the windows' rows together, the windows weighing as given."""
    u, values = corpus
    stacked = np.concatenate([np.sqrt(values)[:, None] * u.T, np.sqrt(weight) * rows])
    _, s, v = np.linalg.svd(stacked, full_matrices=False)
    return v[s > s.max(initial=0) * 1e-9].T


@dataclass
class Model:
    """What finds one block of windows: ``latent`` is each term's part in the latent dot product with each window."""

    terms: np.ndarray
    idf: np.ndarray
    latent: np.ndarray  # (term, window)
    windows: list[Window]

    def __post_init__(self):
        self._masks, self._most = None, None

    def __getstate__(self):
        return self.__dict__ | {"_masks": None, "_most": None}

    def masks(self, k: int):
        if self._masks is None:
            self._masks = {}
        if k not in self._masks:
            w = self.windows[k]
            self._masks[k] = _masks(w.words), _masks(w.words[w.answer :])
        return self._masks[k]

    def candidates(self, tile: np.ndarray, term: np.ndarray, count: np.ndarray, last_tile: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first tile, window, cosine) of passages near an item. ``last_tile`` marks the last tile of each text.

        Passages whose terms together can't reach the threshold with any window, even if no term were in both tiles, are passed over.
        """
        if self._most is None:
            self._most = np.maximum(self.latent.max(axis=1), 0)
        weight = (count * self.idf[term]).astype(np.float32)
        n = len(last_tile)
        most = np.bincount(tile, weight * self._most[term], minlength=n)
        square = np.bincount(tile, weight * weight, minlength=n)
        joined = np.flatnonzero(~last_tile[:-1])  # a tile with the next one of its text
        most[joined], square[joined] = most[joined] + most[joined + 1], square[joined] + square[joined + 1]
        chosen = np.flatnonzero((square > 0) & (most >= 0.999 * COSINE * np.sqrt(square)))
        at = np.searchsorted(tile, np.arange(n + 1))
        for a in range(0, len(chosen), 512):
            mine = chosen[a : a + 512]
            size = np.where(last_tile[mine], at[mine + 1], at[np.minimum(mine + 2, n)]) - at[mine]
            rows = ranges(at[mine], size)
            key = np.repeat(np.arange(len(mine)), size) * len(self.terms) + term[rows]
            order = np.argsort(key, kind="stable")
            w, key = _grouped(weight[rows][order], key[order])
            passage, t = np.divmod(key, len(self.terms))
            norm, groups = _grouped(w * w, passage)
            cosine = _grouped(self.latent[t] * w[:, None], passage)[0] / np.sqrt(norm)[:, None]
            for p, k in zip(*(x.tolist() for x in np.nonzero(cosine >= COSINE)), strict=True):
                yield int(mine[groups[p]]), k, float(cosine[p, k])

    def matches(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, tuple[float, float, float]]]:
        """text: item: (covered, answer covered, cosine), the best of each."""
        tiles, tile, term, count = tile_terms(words, bounds, self.terms)
        out: dict[int, dict[int, tuple[float, float, float]]] = {}
        if not len(tile):
            return out
        last = np.zeros(tiles[-1] + 1, bool)
        last[tiles[1:][np.diff(tiles) > 0] - 1] = True
        last[-1] = True
        for first, k, cosine in self.candidates(tile, term, count, last):
            window = self.windows[k]
            n = len(window.words)
            doc = int(np.searchsorted(tiles, first, "right")) - 1
            at = bounds[doc] + (first - tiles[doc]) * TILE
            around = words[max(bounds[doc], at - n) : min(bounds[doc + 1], at + 2 * TILE + n)].tolist()
            whole, answer = self.masks(k)
            covered = common_subsequence(whole, n, around) / n
            if covered < COVERED:
                continue
            answered = common_subsequence(answer, n - window.answer, around) / (n - window.answer)
            if answered >= ANSWER or covered >= NEARLY_ALL:
                mine = out.setdefault(doc, {})
                mine[window.item] = max(mine.get(window.item, (0.0, 0.0, 0.0)), (covered, answered, cosine))
        return out


class Sequences:
    """Items of few words, found where their words follow one another."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        for length in sorted({len(w) for _, w in items}):
            named: dict[int, list[int]] = {}
            for number, words in items:
                if len(words) == length:
                    named.setdefault(int(self.runs(words, length)[0]), []).append(number)
            self.by_length[length] = np.array(sorted(named), np.uint64), named

    @staticmethod
    def runs(words: np.ndarray, length: int) -> np.ndarray:
        """A hash of every run of so many words."""
        n = len(words) - length + 1
        out = np.zeros(max(n, 0), np.uint64)
        for k in range(length if n > 0 else 0):
            out = mix(out + words[k : k + n])
        return out

    def matches(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item)"""
        for length, (hashes, named) in self.by_length.items():
            runs = self.runs(words, length)
            if not len(runs):
                continue
            hit, at = places(runs, hashes)
            doc = np.searchsorted(bounds, hit, "right") - 1
            inside = hit + length <= bounds[doc + 1]
            for d, k in sorted(set(zip(doc[inside].tolist(), at[inside].tolist(), strict=True))):
                for number in named[int(hashes[k])]:
                    yield d, number


def fit(docs: DataFrame, parts: list[Window], text: str = "text") -> list[Model]:
    """The models of all windows, in blocks: a pass over the documents for frequencies, and one for each TOGETHER blocks."""
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w.words for w in parts)]))
    if not len(every):
        return []
    tiles, df = tile_frequencies(docs, text, every)
    idf = np.log((1 + max(tiles, 1)) / (1 + df)) + 1e-3
    share = -(-len(parts) // -(-len(parts) // WINDOWS))
    blocks = []
    for a in range(0, len(parts), share):
        mine = np.unique(np.concatenate([w.words for w in parts[a : a + share]]))
        blocks.append(Block(parts[a : a + share], mine, idf[np.searchsorted(every, mine)]))
    out = []
    for a in range(0, len(blocks), TOGETHER):
        products, n = gram_times(docs, text, blocks[a : a + TOGETHER])
        for block, product in zip(blocks[a : a + TOGETHER], products, strict=True):
            omega, rows = block.omega().astype(np.float64), block.rows()
            basis = latent_space(axes(product, omega, AXES), rows, WEIGHT * max(1.0, n / len(block.windows)))
            latent = rows @ basis
            latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
            out.append(Model(block.terms, block.idf, (basis @ latent.T).astype(np.float32), block.windows))
    return out


@dataclass
class Benchmark:
    """All items: their ids, the models of their windows, and short ones as word sequences."""

    ids: list
    kind: str
    models: list[Model]
    short: list[tuple[int, np.ndarray]]


def models_for(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> Benchmark:
    """What finds the benchmark's items. The driver holds the benchmark."""
    given = Columns(benchmark)
    kind = given.id_type(item)
    rows = given.frame.select(given.col(item).cast(kind).alias("item"), given.text(item_text).alias("text")).where("text is not null").collect()
    rows = sorted({(r["item"], r["text"]) for r in rows}, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0 if kind == "long" else "", r[1]))
    ids = list(dict.fromkeys(i for i, _ in rows))
    number = {i: k for k, i in enumerate(ids)}
    parts = [w for i, t in rows for w in windows(number[i], t)]
    short = [(number[i], w) for i, t in rows if 0 < len(w := words_of(t)) <= SHORT]
    return Benchmark(ids, kind, fit(docs, parts, text), short)


def annotate(docs: DataFrame, found_by: Benchmark, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The columns with ``matches``: the items found in each row's text, with shares covered and cosine. One pass for all items."""
    spark = docs.sparkSession
    given = Columns(docs, columns, ("matches",))
    matches = f"array<struct<item:{'bigint' if found_by.kind == 'long' else 'string'},covered:double,answer:double,cosine:double>>"
    schema = given.schema(("matches", spark.createDataFrame([], f"m {matches}").schema["m"].dataType))
    shared = [spark.sparkContext.broadcast(m) for m in found_by.models]  # each bounded by WINDOWS
    ids, short = found_by.ids, found_by.short
    kind = pa.list_(pa.struct([("item", pa.int64() if found_by.kind == "long" else pa.string()), ("covered", pa.float64()), ("answer", pa.float64()), ("cosine", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = Sequences(short)
        for batch in batches:
            raw, starts = _lowered(batch.column(batch.num_columns - 1))
            found: list[dict[int, tuple[float, float, float]]] = [{} for _ in range(batch.num_rows)]
            for m in shared:
                model = m.value
                for a, _, words, bounds in _words(raw, starts, 1 << 19):
                    for doc, items in model.matches(words, bounds).items():
                        for i, x in items.items():  # windows of one item may be in several blocks
                            found[a + doc][i] = max(found[a + doc].get(i, x), x)
                if len(shared) > TOGETHER:
                    released([m])  # read again for the next batch, so that one block is held
            if short:
                for a, _, words, bounds in _words(raw, starts, 1 << 19):
                    for doc, i in sequences.matches(words, bounds):
                        found[a + doc][i] = max(found[a + doc].get(i, (0.0, 0.0, 0.0)), (1.0, 1.0, 1.0))
            rows = [[dict(zip(("item", "covered", "answer", "cosine"), (ids[i], *x), strict=True)) for i, x in sorted(f.items())] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=schema.names)
        released(shared)

    return given.named(given.frame.select(*given.passing(), given.text(text)).mapInArrow(tidied(find), schema))


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item found in it: id, item_id, covered, answer, cosine."""
    found = annotate(docs, models_for(docs, benchmark, text, item, item_text), text, [id]).toDF("id", "matches")
    return found.select(F.col("id").alias(id), F.explode("matches").alias("m")).select(F.col(f"`{id}`"), F.col("m.item").alias("item_id"), "m.covered", "m.answer", "m.cosine")
