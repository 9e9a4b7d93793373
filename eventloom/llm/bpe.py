"""Byte-level BPE ids of whole texts, as the ``tokenizers`` library gives them for a vocabulary file.

Where the file's merges make its tokens in the order of their ids, merging by rank gives the same ids,
and the faster of the two installed libraries does it from the file's own tokens. A text with characters that the
two libraries' patterns might class in different ways, or with the string of an added token, goes to ``tokenizers``;
so do all texts if the file is of another kind. The result is that library's either way.
"""

from __future__ import annotations

import json
import re

import numpy as np

from eventloom.llm.common import one_thread

#: The pre-token pattern of the public byte-level vocabularies, in the terms of ``re``.
PRETOKENS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: The same pattern as it is published with them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Anything but characters that all these regular-expression libraries class alike: ASCII without
#: control characters other than white space, Latin letters and signs, common dashes and quotes.
UNSURE = re.compile("[^\t-\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ɏ–—‘-”•…€]")
#: Bytes of UTF-8 that need no look at the characters: white space and printable ASCII, and the letters from U+00C0 to U+024F.
SURE_BYTES = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
#: Distinct pre-tokens that a worker keeps solved; beyond that it starts anew. Bounds memory, not results.
CACHE_WORDS = 600_000


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: printable Latin-1 for itself, the others from 256 up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts for a ``tokenizers`` file."""

    def __init__(self, path: str):
        one_thread()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_words = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.library.get_vocab_size()
        self.by_rank = self._ranked(spec) if self.by_words else None

    def _ranked(self, spec: dict):
        """The encoder by ranks, if every byte has a token and merge k makes the k-th token after the bytes."""
        import tiktoken

        model, back = spec["model"], byte_alphabet()
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        single = [vocab.get(c, -1) for c in back]
        made = [vocab.get("".join(m), -1) for m in merges]
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if odd or min(single) < 0 or made != list(range(max(single) + 1, max(single) + 1 + len(made))) or len(vocab) != len(single) + len(made):
            return None
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        """Whether all libraries here split the text alike."""
        if not self.by_words or any(x in text for x in self.added):
            return False
        return not text.encode().translate(None, SURE_BYTES) or not UNSURE.search(text)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit integers, without special tokens."""
        if self.by_rank is not None and self.plain(text):
            return self.by_rank.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
