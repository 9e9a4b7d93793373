"""Language identification by prediction by partial matching.

For each language a context tree over lower-cased bytes keeps how often each byte followed each
context of up to ``ORDER`` bytes. A byte that followed its context costs the logarithm of its share
among n + q, for n bytes seen and q different ones; any other costs the escape q / (n + q) and is asked of the
context one byte shorter, down to a uniform byte. The statistics are frozen, so the exact code length of a text under every
language is a sum of table entries. The shortest wins; the score is its posterior under equal priors.

The trees of all languages share their nodes, of which all are kept. A node's number follows from that of the gram without
its last byte, so one table look-up a level finds the nodes for every position of many texts at once; a level with
too many nodes for a table is searched instead, with the same result.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when
no language was learned. Ties go to the language first in order. Rows with null language or null or empty text teach nothing, and a language of no other rows is not learned.
Of every other language a piece of a text is learned at least.
Repeated rows are each predicted. A very long text is a step of its own, whole, and its worker holds some numbers for each of its bytes. Other columns pass through, and an output
column that clashes with one, in any case of letters, replaces it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Columns, chunks, held, text_buffer, tidied

#: Bytes of the longest context.
ORDER = 4
#: Labelled rows that teach, over all languages, each with an equal share, and their bytes of text; chosen by a hash of the row, in pieces.
MAX_ROWS, MAX_BYTES = 1600, 16 << 20
#: Code points of a text that are drawn at once.
PIECE = 20_000
#: Entries of a level's table of nodes; a larger one is searched.
TABLE = 32_000_000
#: Bytes of text scored in one step.
STEP_BYTES = 1 << 20


def grams(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """All byte grams of this length that lie within a text, as integers."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for k in range(length):
        out = (out << 8) | raw[k : n + k]
    first = np.searchsorted(starts, np.arange(n), "right")
    last = np.searchsorted(starts, np.arange(n) + length - 1, "right")
    return out[first == last]


@dataclass
class Model:
    """Languages and, for each gram length, the grams kept with their code lengths and the escapes of contexts."""

    languages: list[str]
    codes: list[np.ndarray]  # sorted grams
    cost: list[np.ndarray]  # (gram, language), bits of the last byte after the others
    escape: list[np.ndarray]  # for a gram as context: (gram, language), bits; last entry: the empty context

    def __post_init__(self):
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def tables(self):
        """Byte classes, child tables (None for a level that is searched), costs and escapes, with row 0 for what is not in the tree."""
        if self._tables is None:
            seen = self.codes[0]
            classes = np.zeros(256, np.int64)
            classes[seen] = np.arange(1, len(seen) + 1)
            width = len(seen) + 1
            children = []
            for level in range(1, len(self.codes)):
                if (len(self.codes[level - 1]) + 1) * width > TABLE:
                    children.append(None)
                    continue
                table = np.zeros((len(self.codes[level - 1]) + 1, width), np.int32)
                parent = np.searchsorted(self.codes[level - 1], self.codes[level] >> 8) + 1
                table[parent, classes[self.codes[level] & 255]] = np.arange(1, len(self.codes[level]) + 1)
                children.append(table.ravel())
            pad = lambda x: np.concatenate([np.zeros((1, len(self.languages)), np.float32), x.astype(np.float32)])
            cost = [pad(x) for x in self.cost]
            cost[0][0] = self.escape[-1] + 8.0  # a byte that no language has
            self._tables = classes, width, children, cost, [pad(x) for x in self.escape[:-1]]
        return self._tables

    def _searched(self, level: int, before: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Nodes of a level from those of the gram without its last byte."""
        code = self.codes[level - 1][np.maximum(before - 1, 0)] << 8 | raw
        at = np.searchsorted(self.codes[level], code)
        at[at == len(self.codes[level])] = 0
        return np.where((before > 0) & (self.codes[level][at] == code), at + 1, 0) if len(self.codes[level]) else np.zeros(len(raw), np.int64)

    def code_lengths(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of every text under every language."""
        classes, width, children, cost, escape = self.tables()
        n = len(raw)
        out = np.zeros((len(starts) - 1, len(self.languages)))
        filled = np.flatnonzero(np.diff(starts) > 0)
        if not len(filled):
            return out
        begin = starts[filled]
        byte = classes[raw]
        nodes = [byte]
        for level, table in enumerate(children, 1):
            before = np.empty(n, np.int64)
            before[0], before[1:] = 0, nodes[-1][:-1]
            before[begin] = 0
            if table is None:
                nodes.append(self._searched(level, before, raw))
                continue
            before *= width
            before += byte
            nodes.append(table[before].astype(np.int64))
        bits = cost[-1][nodes[-1]]
        left = np.flatnonzero(nodes[-1] == 0)
        is_begin = np.zeros(n, bool)
        is_begin[begin] = True
        for level in range(len(children) - 1, -1, -1):
            # the context one byte longer was of no use here: pay its escape, if any language knows it
            context = np.where(is_begin[left], 0, nodes[level][left - 1])
            found = nodes[level][left]
            bits[left] += escape[level][context]
            if level:
                hit = found > 0
                bits[left[hit]] += cost[level][found[hit]]
                left = left[~hit]
            else:
                bits[left] += cost[0][found]
        out[filled] = np.add.reduceat(bits, begin, axis=0, dtype=np.float64)
        return out


def build(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from (sorted grams, counts (gram, language)) of each gram length."""
    codes, cost, escape = [], [], []
    lower_codes, lower_cost = None, None
    out_escape = []
    for level, (code, count) in enumerate(counts):
        context = code >> 8 if level else np.zeros(len(code), np.int64)
        names, where = np.unique(context, return_inverse=True)
        n = np.zeros((len(names), len(languages)))
        q = np.zeros((len(names), len(languages)))
        np.add.at(n, where, count)
        np.add.at(q, where, count > 0)
        known = n > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(known, -np.log2(q / (n + q)), 0.0)
            direct = -np.log2(count / (n + q)[where])
        if level:
            # what follows a context follows it without its first byte too, so both are in the tree
            under = lower_cost[np.searchsorted(lower_codes, code & ((1 << 8 * level) - 1))]
            slot = np.zeros((len(lower_codes), len(languages)))
            slot[np.searchsorted(lower_codes, names)] = leave
            out_escape.append(slot)
        else:
            under = np.full((len(code), len(languages)), 8.0)
            root = leave[0] if len(leave) else np.zeros(len(languages))
        bits = np.where(count > 0, direct, leave[where] + under)
        lower_codes, lower_cost = code, bits
        codes.append(lower_codes)
        cost.append(lower_cost)
    escape = [*out_escape, root]
    return Model(languages, codes, cost, escape)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", order: int = ORDER, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """The model from these rows; leave held-out rows out of ``docs``. The driver gets gram counts of the bounded sample."""
    given = Columns(docs)
    taught = given.frame.select(given.col(id).alias("id"), given.text(text).alias("text"), given.text(lang).alias("lang")).where("lang is not null and text is not null")
    # a long text teaches by pieces, each drawn by itself
    pieces = F.expr(f"sequence(0, greatest(cast(ceil(length(text) / {PIECE}) as int), 1) - 1)")
    taught = taught.select("id", "lang", "text", F.length("text").alias("n"), F.explode(pieces).alias("k"))
    spread = F.when(F.col("k") == 0, F.xxhash64("id", "n")).otherwise(F.xxhash64("id", "n", "k"))
    taught = taught.select("lang", F.when(F.col("n") <= PIECE, F.col("text")).otherwise(F.substring("text", F.col("k") * PIECE + 1, F.lit(PIECE))).alias("text"), (F.pmod(spread, F.lit(1 << 30)) / float(1 << 30)).alias("spread"))
    total = {r["lang"]: r for r in taught.where("text <> ''").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("spread").alias("least")).collect()}  # one row a language
    languages = sorted(total)
    if not languages:
        return Model([], [], [], [])
    # a language keeps its first piece at least, by the hash
    rate = {k: max(r["least"], min(1.0, max_rows / len(languages) / r["n"], max_bytes / len(languages) / max(r["bytes"], 1))) for k, r in total.items()}
    rates = F.create_map(*[F.lit(x) for pair in rate.items() for x in pair])
    number = F.create_map(*[F.lit(x) for k, v in enumerate(languages) for x in (v, k)])
    sample = taught.where((F.col("text") != "") & (F.col("spread") <= rates[F.col("lang")])).select(number[F.col("lang")].alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            texts = pc.utf8_lower(batch.column(1))
            for k in np.unique(number).tolist():
                raw, starts = text_buffer(texts.filter(pa.array(number == k)))
                for a, b in chunks(starts):
                    for length in range(1, order + 2):
                        code, n = np.unique(grams(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a], length), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k), pa.int32()), pa.array(np.full(len(code), length), pa.int32()), pa.array(code), pa.array(n)], names=["lang", "length", "gram", "n"])

    found = sample.mapInArrow(tidied(count), "lang int, length int, gram long, n long").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang_at, length, gram, n = (found.column(c).to_numpy() for c in ("lang", "length", "gram", "n"))
    counts = []
    for k in range(1, order + 2):
        at = length == k
        code, where = np.unique(gram[at], return_inverse=True)
        matrix = np.zeros((len(code), len(languages)))
        matrix[where, lang_at[at]] = n[at]
        counts.append((code, matrix))
    return build(languages, counts)


def predict(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The columns with lang_pred, score and bits, the shortest code length."""
    given = Columns(docs, columns, ("lang_pred", "score", "bits"))
    schema = given.schema(("lang_pred", "string"), ("score", "double"), ("bits", "double"))
    words = given.text(text)
    source = given.frame.select(*given.passing(), F.coalesce(words.rlike(r"\p{L}"), F.lit(False)).alias("letter"), words.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the bounded sample

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(shared, "languages")
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            n = batch.num_rows
            best, score, bits = np.full(n, len(model.languages)), np.zeros(n), np.zeros(n)
            if model.languages:
                letter = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
                raw, starts = text_buffer(pc.utf8_lower(batch.column(batch.num_columns - 1)))
                for a, b in chunks(starts, STEP_BYTES):
                    length = model.code_lengths(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                    low = length.min(axis=1)
                    best[a:b], bits[a:b] = length.argmin(axis=1), low
                    score[a:b] = 1 / np.exp2(np.maximum(low[:, None] - length, -1000)).sum(axis=1)
                best[~letter], score[~letter] = len(model.languages), 0.0
            columns = [*batch.columns[:-2], pa.array(names[best], pa.string()), pa.array(score), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.named(source.mapInArrow(tidied(apply), schema))


