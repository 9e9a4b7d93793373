"""Token counts by prefix dynamic programming: the exact count at every prefix of a text.

For each prefix of a pre-token exactly one vocabulary token ends its encoding: the token t such that
the encoding of the prefix without t, followed by t, is what the merges give. That last token and the
count follow from shorter prefixes: ``count[i] = count[i - len(t)] + 1``, where t is compatible with
the last token at ``i - len(t)``. Whether two tokens may stand side by side is asked of the library once for each
pair. The table answers how many tokens a truncated text has, and the longest prefix within a budget,
without encoding again.

Pre-tokens are the library's in every script; those of characters that several libraries class alike are found faster. An added token's
string counts as that token, and a prefix that ends inside it as the text that it is. Words longer than the last of ``_WIDTHS``
are solved one by one, in time in proportion to their length.

Defined results: null or empty text has 0 bytes, 0 tokens, and a budget prefix of 0. Rows are counted
one by one, so repeated rows, null ids and extra columns pass through; an output column that clashes
with an input column, in any case of letters, replaces it. A very long text is a step of its own, and its worker holds its counts at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.bpe import CACHE_WORDS, PRETOKENS, byte_alphabet, encoder
from eventloom.llm.common import Columns, chunks, mix, text_buffer, tidied

_B = np.uint64(0xD6E8FEB86659FD93)
#: Characters of the pre-tokens that are solved together, to keep the table of a batch narrow; longer ones go one by one.
_WIDTHS = (8, 16, 32, 96)
#: Contractions: their inner prefixes fall into other pre-tokens than the whole does.
_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixTable:
    """last token and count for every byte prefix of pre-tokens, for one byte-level vocabulary."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        if not self.encoder.by_words:
            raise ValueError(f"{path} holds no byte-level vocabulary, which the prefix table is for")
        lib = self.encoder.library
        back = byte_alphabet()
        self.tokens: dict[bytes, int] = {}
        for text, i in lib.get_vocab(with_added_tokens=False).items():
            raw = bytes(back[c] for c in text if c in back)
            if len(raw) == len(text) and text not in self.encoder.added:
                self.tokens[raw] = i
        self.raw = dict((i, t) for t, i in self.tokens.items())
        self.longest = max(map(len, self.tokens))
        keys = np.array([_hash(t) for t in self.tokens], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.fromiter(self.tokens.values(), np.int64)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two tokens share a hash")
        self.lengths = sorted({len(t) for t in self.tokens})
        self.known = self.recent = _NOTHING  # sorted pairs and whether they fit; the recent ones are merged in now and then
        self.pairs: dict[int, bool] = {}
        self.steps: dict[str, bytes] = {}
        self._automaton = None
        added = sorted(self.encoder.added, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        split = lib.pre_tokenizer.pre_tokenize_str
        spaces = "".join(c for c in _SPACES if len(split(f"!{c}{c}")) > 1)
        self.spaces = re.compile(f"[{re.escape(spaces)}]{{2,}}")

    # -- pairs
    def _bpe(self, raw: bytes) -> list[int]:
        """Ids of a byte string by the model alone, with no pre-tokenizer before it."""
        text = "".join(_ALPHABET[c] for c in raw)
        return [t.id for t in self.encoder.library.model.tokenize(text)]

    def fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (left << 20 | right) may stand side by side: whether the library leaves it as it is. Each pair is asked for once."""
        out, left = np.zeros(len(pairs), bool), np.arange(len(pairs))
        for keys, values in (self.known, self.recent):
            if len(keys) and len(left):
                at = np.searchsorted(keys, pairs[left])
                at[at == len(keys)] = 0
                hit = keys[at] == pairs[left]
                out[left[hit]] = values[at[hit]]
                left = left[~hit]
        if len(left):
            new, where = np.unique(pairs[left], return_inverse=True)
            fits = np.fromiter((self._bpe(self.raw[p >> 20] + self.raw[p & 0xFFFFF]) == [p >> 20, p & 0xFFFFF] for p in new.tolist()), bool, len(new))
            out[left] = fits[where]
            self.recent = _merged(self.recent, (new, fits))
            if 8 * len(self.recent[0]) > len(self.known[0]) + 4096:
                self.known, self.recent = _merged(self.known, self.recent), _NOTHING
        return out

    # -- the recurrence
    def solve(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Last token and token count of every byte prefix: two arrays (word, prefix length)."""
        n, width = len(words), max(map(len, words), default=0)
        size = np.fromiter(map(len, words), np.int64, n)
        table = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).astype(np.uint64) + np.uint64(1)
        # h[:, i] hashes the first i bytes; that of bytes i-l to i is h[i] - h[i-l] * B**l
        h = np.zeros((width + 1, n), np.uint64)
        for i in range(width):
            h[i + 1] = h[i] * _B + table[:, i]
        powers = [np.uint64(pow(int(_B), k, 2**64)) for k in range(width + 1)]
        last = np.full((width + 1, n), -1, np.int64)
        count = np.zeros((width + 1, n), np.int32)
        for i in range(1, width + 1):
            todo = np.flatnonzero(size >= i)
            for length in reversed(self.lengths):
                if length > i or not len(todo):
                    continue
                j = i - length
                key = mix(h[i, todo] - h[j, todo] * powers[length]) if length > 1 else mix(h[i, todo] - h[j, todo] * _B)
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                found = self.keys[at] == key
                if not found.any():
                    continue
                rows, ids = todo[found], self.ids[at[found]]
                if j:
                    ok = self.fit(last[j, rows] << 20 | ids)
                    rows, ids = rows[ok], ids[ok]
                last[i, rows], count[i, rows] = ids, count[j, rows] + 1
                todo = todo[last[i, todo] < 0]
        return last.T, count.T

    def solve_long(self, word: bytes) -> np.ndarray:
        """Token counts of every byte prefix of one word, in time in proportion to its length: an automaton
        names the tokens that end at each byte, and the one that fits its predecessor ends the prefix."""
        last, count = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        fits, ask = self.pairs, self._bpe
        if len(fits) > 1_000_000:
            fits.clear()
        for end, (token, length) in self.automaton.iter(word.decode("latin-1")):
            i, j = end + 1, end + 1 - length
            if last[i] >= 0:
                continue
            if j:
                pair = last[j] << 20 | token
                ok = fits.get(pair)
                if ok is None:
                    ok = fits[pair] = ask(self.raw[last[j]] + self.raw[token]) == [last[j], token]
                if not ok:
                    continue
            last[i], count[i] = token, count[j] + 1
        return np.array(count, np.int64)

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for raw, i in self.tokens.items():
                self._automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
            self._automaton.make_automaton()
        return self._automaton

    def learn(self, words: set[str]) -> None:
        """Solves the pre-tokens not seen before: for each the steps of the count from one prefix to the next, by characters."""
        new = [w for w in words if w not in self.steps]
        if len(self.steps) + len(new) > CACHE_WORDS:
            self.steps.clear()
            new = list(words)
        if len(self.known[0]) > 2_000_000:
            self.known = self.recent = _NOTHING
        by_width: dict[int, list[str]] = {}
        for w in new:
            by_width.setdefault(next((k for k in _WIDTHS if len(w) <= k), 0), []).append(w)
        for width, group in by_width.items():
            raw = [w.encode() for w in group]
            small = 20_000 if width else 1
            for a in range(0, len(raw), small):
                part = raw[a : a + small]
                count = self.solve(part)[1] if width else self.solve_long(part[0])[None, :]
                self._keep(group[a : a + small], part, count)

    def _keep(self, words: list[str], raw: list[bytes], count: np.ndarray) -> None:
        """Keeps the steps of these words from the counts of their byte prefixes, at the ends of characters."""
        width = count.shape[1] - 1
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        # a byte is the last of its character if the next one begins another, or there is none
        table = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in raw), np.uint8).reshape(len(raw), width)
        last = np.ones((len(raw), width), bool)
        last[:, :-1] = (table[:, 1:] & 0xC0) != 0x80
        last &= np.arange(width)[None, :] < size[:, None]
        flat = count[:, 1:][last].astype(np.int64)
        ends = np.cumsum(last.sum(axis=1))
        steps = np.diff(flat, prepend=0)
        steps[ends[:-1]] = flat[ends[:-1]]
        blob = steps.astype("<i2").tobytes()
        for w, a, b in zip(words, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            self.steps[w] = blob[2 * a : 2 * b]
        for w in _CONTRACTIONS:
            if w in words:
                found = flat[ends[words.index(w)] - 3 : ends[words.index(w)]].copy()
                found[1] = found[0] + 1
                self.steps[w] = np.diff(found, prepend=0).astype("<i2").tobytes()

    # -- whole texts
    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens, by the library's own splitter where other patterns might class its characters otherwise."""
        if self.encoder.plain(text):
            return PRETOKENS.findall(text)
        return [text[a:b] for _, (a, b) in self.encoder.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[tuple[list[str], str]]:
        """The text as stretches between added tokens: (pre-tokens, the added token behind them)."""
        if self.added is None or not self.added.search(text):
            return [(self.split(text), "")]
        out, at = [], 0
        for m in self.added.finditer(text):
            out.append((self.split(text[at : m.start()]), m[0]))
            at = m.end()
        return [*out, (self.split(text[at:]), "")]

    def _stretch(self, words: list[str]) -> np.ndarray:
        """Tokens of every prefix of a stretch whose pre-tokens are known."""
        out = np.cumsum(np.frombuffer(b"".join(map(self.steps.__getitem__, words)), "<i2"), dtype=np.int64)
        text = "".join(words)
        # a prefix that ends with white space takes all of the white space before its end as one pre-token
        for a, b in self._runs(text):
            out[b - 1] = (out[a - 1] if a else 0) + self._total(text[a:b])
        return out

    def _runs(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.spaces.finditer(text) if m.end() < len(text)]

    def _total(self, word: str) -> int:
        if word not in self.steps:
            self.learn({word})
        return int(np.frombuffer(self.steps[word], "<i2").sum())

    def _whole(self, words: list[str]) -> int:
        return sum(map(self._total, words))

    def _counts(self, parts: list[tuple[list[str], str]]) -> np.ndarray:
        out, base = [np.zeros(1, np.int64)], 0
        for words, added in parts:
            mine = self._stretch(words)
            out.append(base + mine)
            base += int(mine[-1]) if len(mine) else 0
            if added:
                # a part of an added token is text like any other, and may change the pre-token before it
                tail = words[-3:]
                before, end = base - self._whole(tail), "".join(tail)
                out.append(np.array([*(before + self._whole(self.split(end + added[:k])) for k in range(1, len(added))), base + 1], np.int64))
                base += 1
        return np.concatenate(out)

    def _learn_texts(self, split: list[list[tuple[list[str], str]]]) -> None:
        words: set[str] = set()
        for parts in split:
            for mine, _ in parts:
                words.update(mine)
                text = "".join(mine)
                words.update(text[a:b] for a, b in self._runs(text))
        self.learn(words)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of every prefix, by characters: entry i is the count of ``text[:i]`` encoded by itself."""
        parts = self.parts(text)
        self._learn_texts([parts])
        return self._counts(parts)

    def stats(self, texts: list[str], limit: int) -> list[tuple[int, int, np.ndarray]]:
        """For each text: its tokens, the characters of its longest prefix that fits the limit, and the counts of all prefixes."""
        split = [self.parts(t) for t in texts]
        self._learn_texts(split)
        out = []
        for text, parts in zip(texts, split, strict=True):
            counts = self._counts(parts)
            n = int(counts[-1])
            out.append((n, len(text) if n <= limit else int(np.flatnonzero(counts <= limit)[-1]), counts))
        return out


_ALPHABET = {b: c for c, b in byte_alphabet().items()}
#: Characters that some library takes for white space; which ones a vocabulary's does is asked.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


_NOTHING = np.zeros(0, np.int64), np.zeros(0, bool)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, values = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _hash(raw: bytes) -> int:
    h = 0
    for c in raw:
        h = (h * int(_B) + c + 1) % 2**64
    return int(mix(np.array([h], np.uint64))[0])


_TABLES: dict[str, PrefixTable] = {}


def prefix_table(path: str) -> PrefixTable:
    """One table a worker process, kept between tasks."""
    if path not in _TABLES:
        _TABLES[path] = PrefixTable(path)
    return _TABLES[path]


def pack_counts(counts: np.ndarray) -> bytes:
    """Prefix counts as compressed differences; ``unpack_counts`` gives them back."""
    steps = np.diff(counts, prepend=0)
    small = not len(steps) or (steps.min() >= -128 and steps.max() <= 127)
    return (b"1" if small else b"2") + zlib.compress(steps.astype("<i1" if small else "<i2").tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob[1:]), "<i1" if blob[:1] == b"1" else "<i2").astype(np.int64))


def truncated(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix within a budget of tokens, from stored counts."""
    return int(np.flatnonzero(counts <= budget)[-1])


def token_counts(docs: DataFrame, path: str, text: str = "text", budget: int = 1024, store: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with n_bytes, n_tokens and budget_chars, the characters of the longest prefix within the budget.

    With ``store`` also prefix_counts, the packed count at every prefix, for later questions. One
    narrow pass; nothing is shuffled.
    """
    made = [("n_bytes", "long"), ("n_tokens", "long"), ("budget_chars", "long"), *([("prefix_counts", "binary")] if store else [])]
    given = Columns(docs, keep, [name for name, _ in made])
    schema = given.schema(*made)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(path)
        for batch in batches:
            raw, starts = text_buffer(batch.column(batch.num_columns - 1))
            for a, b in chunks(starts):  # so that prefix counts of few texts are held at once
                texts = [t or "" for t in batch.column(batch.num_columns - 1).slice(a, b - a).to_pylist()]
                found = table.stats(texts, budget)
                columns = [*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(np.diff(starts[a : b + 1])), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))]
                if store:
                    columns.append(pa.array([pack_counts(f[2]) for f in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.named(given.frame.select(*given.passing(), given.text(text)).mapInArrow(tidied(count), schema))
