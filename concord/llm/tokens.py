"""Token ids of whole texts by the public tokenizer files, as little-endian 16-bit integers."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np

#: Characters on whose classes all libraries agree: Latin and common punctuation.
UNSURE = re.compile("[^\x00-ɏ‐-‧€]")
#: A single sign after a letter and before white space or the end: a word of its own.
#: The sign comes first in the pattern, so that the search skips to signs.
LONE_SIGN = re.compile(r"([,.;:!?])(?<=[A-Za-zß-öø-ÿ].)(?=[ \n]|$)")
#: Chunks remembered, twice over.
KEEP = 500_000
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, [x.content for x in t.get_added_tokens_decoder().values()]


class ByteEncoder:
    """Ids of a byte-level BPE file. Texts of Latin letters without special strings go to tiktoken with the
    same vocabulary, which gives the same ids faster; all others to the tokenizers library itself."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self._tokenizer, self._special = _load(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if UNSURE.search(text) or any(s in text for s in self._special):
            return array("H", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("H", self._fast.encode_ordinary(text)).tobytes()


class WordEncoder:
    """Ids of a BPE file with word ends, which drops white space: a text's ids are those of its chunks between
    blanks and line ends. Chunks are encoded once and remembered while they keep coming back."""

    def __init__(self, path: str, keep: int = KEEP):
        self._tokenizer, special = _load(path)
        self._mark = special[0][:2]
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(len(vocabulary), bool)
        self._ends[[k for piece, k in vocabulary.items() if piece.endswith("</w>")]] = True
        self._keep, self._of, self._older = keep, {"": b""}, {}

    def _learn(self, chunks: list[str]) -> None:
        if len(self._of) > self._keep:
            self._older, self._of = self._of, {"": b""}
        words, others = [], []
        for c in dict.fromkeys(chunks):
            if c not in self._of:
                if c in self._older:
                    self._of[c] = self._older[c]
                else:
                    (words if PLAIN(c) else others).append(c)
        for at in range(0, len(words), 4096):
            self._encode_words(words[at : at + 4096])
        if others:
            self._encode_others(others)

    def _encode_words(self, words: list[str]) -> None:
        """All at once: each is one word to the tokenizer, and its last id is a word end."""
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u2")
        cut = [0, *((np.flatnonzero(self._ends[ids]) + 1) * 2).tolist()]
        if len(cut) != len(words) + 1:
            raise ValueError("a word without its one word end")
        raw = ids.tobytes()
        self._of.update((w, raw[a:b]) for w, a, b in zip(words, cut, cut[1:], strict=False))

    def _encode_others(self, chunks: list[str]) -> None:
        """All at once; offsets tell which id is of which chunk."""
        e = self._tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        ids = array("H", e.ids).tobytes()
        starts = np.cumsum([0, *(len(c) + 1 for c in chunks)])
        at = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
        cut = (2 * np.searchsorted(at, starts)).tolist()
        self._of.update((c, ids[a:b]) for c, a, b in zip(chunks, cut, cut[1:], strict=False))

    def encode(self, text: str) -> bytes:
        if self._mark not in text and not UNSURE.search(text):  # the file's normalizer lower-cases as well
            text = LONE_SIGN.sub(r" \1", text.lower())
        chunks = text.replace("\n", " ").split(" ")
        try:
            return b"".join([self._of[c] for c in chunks])
        except KeyError:
            self._learn(chunks)
            return b"".join([self._of[c] for c in chunks])


@lru_cache(maxsize=4)
def encoder(path: str, keep: int = KEEP) -> ByteEncoder | WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path, keep) if "word_" in path.rpartition("/")[2] else ByteEncoder(path)
