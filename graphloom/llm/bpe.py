"""Byte-level BPE: merges by a priority queue over a doubly linked symbol list."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import regex

#: Folder of the public vocabularies; another one can be named in every call or in this variable.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DEFAULT_VOCABULARY = "byte_bpe_50k.json"

# Fixed value: the public pattern that splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words whose ids are kept, and the longest word (in bytes) that is kept: both bound memory, not results.
CACHE_WORDS, CACHE_WORD_BYTES = 1 << 17, 64

_PAIR, _PLACES = 1 << 20, 1 << 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file, by its public rule."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class Encoder:
    """Encodes text to ids without special tokens; special tokens' strings in a text are ordinary text."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocabulary.items() if all(c in back for c in s)}
        self._byte_ids = [vocabulary[c] for c in alphabet]
        # rank of each pair, and the symbols that a rank joins
        self._rank: dict[int, int] = {}
        self._joins: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._joins.append((vocabulary[left], vocabulary[right], vocabulary[left + right]))
            self._rank.setdefault(vocabulary[left] * _PAIR + vocabulary[right], rank)
        self._sizes = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self._sizes[i] = len(b)
        self._cache: dict[str, tuple[int, ...]] = {}
        self.words = regex.compile(PATTERN).findall
        self.finditer = regex.compile(PATTERN).finditer

    @classmethod
    def load(cls, path: str) -> Encoder:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], model["merges"])

    def _merged(self, data: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self._byte_ids[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank, joins = self._rank.get, self._joins
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry holds a pair's rank and the place of its left symbol in one number: leftmost first on equal ranks
        queue = [r * _PLACES + i for i in range(n - 1) if (r := rank(ids[i] * _PAIR + ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            r, i = divmod(heappop(queue), _PLACES)
            left, right, new = joins[r]
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two symbols has been merged since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new * _PAIR + ids[k])) is not None:
                    heappush(queue, r * _PLACES + i)
            h = before[i]
            if h >= 0 and (r := rank(ids[h] * _PAIR + new)) is not None:
                heappush(queue, r * _PLACES + h)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        found = self._cache.get(word)
        if found is None:
            data = word.encode("utf-8", "surrogatepass")
            found = tuple(self._merged(data))
            if len(data) <= CACHE_WORD_BYTES:
                if len(self._cache) >= CACHE_WORDS:
                    self._cache.clear()
                self._cache[word] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; null and empty texts have none."""
        out: list[int] = []
        if not text:
            return out
        cache, word = self._cache.get, self.word
        for w in self.words(text):
            out += cache(w) or word(w)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        cache, word = self._cache.get, self.word
        return sum(len(cache(w) or word(w)) for w in self.words(text))

    def spans(self, text: str, over: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The byte position in UTF-8 after each token; of each word before merging, where it begins in the text and how
        many tokens stand before it (both with the text's own end last). None if there are no more than ``over`` tokens."""
        cache, word = self._cache.get, self.word
        words = self.words(text)
        parts = [cache(w) or word(w) for w in words]
        sizes = list(map(len, parts))
        n = sum(sizes)
        if n <= over:
            return None
        ids = np.fromiter(chain.from_iterable(parts), np.int64, n)
        return np.cumsum(self._sizes[ids]), np.cumsum([0, *map(len, words)]), np.cumsum([0, *sizes])

    def decode(self, ids) -> str:
        """The text of ``ids``: their vocabulary strings joined."""
        return b"".join(self.bytes_of[int(i)] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(name: str = DEFAULT_VOCABULARY, folder: str | None = None) -> Encoder:
    """The encoder of one vocabulary file, loaded once per process."""
    return Encoder.load(os.path.join(folder or TOKENIZER_DIR, name))
