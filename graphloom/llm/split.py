"""Cutting oversized texts at natural boundaries into overlapping pieces."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import join_lookup
from ..session import spread
from .bpe import DEFAULT_VOCABULARY, TOKENIZER_DIR, Encoder, encoder

LEVELS = ("section", "paragraph", "sentence", "word", "character")

# A match marks a boundary at its end; white space after a boundary goes to the piece before where tokens allow it.
_SECTION = regex.compile(
    r"\n(?=\#{1,6}[ \t]"  # headings
    r"|---[ \t]*\r?\n|===+[ \t]*\r?\n"  # front matter and rules
    r"|[\p{L}\p{N}_.@-]{1,40} ?\([^()\n]{1,40}\): |[\p{L}\p{N}_.-]{1,40}: "  # messages of a thread
    r"|(?:export |default |async |public |private |abstract |pub |final )*(?:def|class|function|fn|func|struct|enum|impl|trait|interface|type|mod|module|extension|protocol|const|let|var|test|describe)\b"  # definitions
    r"|@\p{L}|router\.|app\.|\#\[)"
)
_PARAGRAPH = regex.compile(r"\n[^\S\n]*\n\s*|\r\r\s*| ")
_SENTENCE = regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+|\r?\n[^\S\n]*|\r| ")
_WORD = regex.compile(r"\s+")


class Boundaries:
    """Token indexes of each level's boundaries, found when a level is first asked for: most texts never need words.

    ``at`` holds the character position of each token index, or -1 where a token ends inside a character.
    """

    def __init__(self, text: str, at: np.ndarray):
        self.text = text
        self.tokens = np.flatnonzero(at >= 0)
        self.index = np.full(len(text) + 1, -1, np.int64)
        self.index[at[self.tokens]] = self.tokens
        self.found: dict[int, list[int]] = {}

    def __len__(self) -> int:
        return len(LEVELS)

    def __getitem__(self, level: int) -> list[int]:
        if level not in self.found:
            self.found[level] = self.tokens.tolist() if level == len(LEVELS) - 1 else self._matches((_SECTION, _PARAGRAPH, _SENTENCE, _WORD)[level])
        return self.found[level]

    def _matches(self, pattern) -> list[int]:
        spans = np.array([m.span() for m in pattern.finditer(self.text)], np.int64).reshape(-1, 2)
        starts, ends = spans[:, 0], spans[:, 1].copy()
        while True:  # back to where a token ends, within the match
            back = (self.index[ends] < 0) & (ends > starts)
            if not back.any():
                break
            ends[back] -= 1
        found = self.index[ends]
        return np.unique(found[found >= 0]).tolist()


def _units(levels: Boundaries, n: int, cap: int) -> list[tuple[int, int]]:
    """Ends of consecutive units of at most ``cap`` tokens with the level of each end, from coarse to fine."""
    out: list[tuple[int, int]] = []
    stack = [(0, n, -1, 0)]  # begin, end, level of the end, level to split by
    while stack:
        lo, hi, mark, level = stack.pop()
        if hi - lo <= cap:
            out.append((hi, mark))
            continue
        if level == len(levels):
            out.append((hi, mark))  # one character of more tokens than the cap
            continue
        marks = levels[level]
        inner = marks[bisect_right(marks, lo) : bisect_left(marks, hi)]
        if level == len(levels) - 1:  # any character boundary: as far as the cap reaches
            ends, begin = [], lo
            while hi - begin > cap:
                k = bisect_right(inner, begin + cap)
                if not k or inner[k - 1] <= begin:  # the next character alone is over the cap
                    if k == len(inner):
                        break
                    k += 1
                begin = inner[k - 1]
                ends.append(begin)
            inner = ends
        parts = list(zip([lo, *inner], [*inner, hi]))
        for i in range(len(parts) - 1, -1, -1):
            stack.append((*parts[i], mark if i == len(parts) - 1 else level, level + 1))
    return out


class Counts:
    """Token counts of parts of one text, each as if encoded on its own.

    The words before merging are the same in a part as in the text but near the part's ends: from the first place on
    where both begin a word, up to the last word that ends before the white space at the part's end. Only what lies
    outside is encoded again.
    """

    def __init__(self, text: str, starts: np.ndarray, before: np.ndarray, enc: Encoder):
        self.text, self.enc, self.starts, self.before = text, enc, starts.tolist(), before.tolist()
        self.places = dict(zip(self.starts, self.before))

    def count(self, a: int, b: int) -> int:
        text, enc = self.text, self.enc
        tail = b
        while tail > a and text[tail - 1].isspace():
            tail -= 1
        tail = self.starts[bisect_left(self.starts, tail) - 1] if tail > a else a
        at, n = a, 0
        if at not in self.places:
            for m in enc.finditer(text, a, b):
                n += len(enc.word(m.group()))
                at = m.end()
                if at in self.places:
                    break
        if at >= tail:  # too short for a part in common
            return enc.count(text[a:b])
        return n + self.places[tail] - self.places[at] + enc.count(text[tail:b])


def split_text(text: str, limit: int, overlap: int, enc: Encoder) -> list[tuple]:
    """Pieces of a text with more than ``limit`` tokens: (token_start, token_end, char_start, char_end, n_tokens, cut_at).

    A text within the limit gives no pieces. Sections that are too large are split by paragraphs, those by
    sentences and lines, those by words, those by characters; the units are packed greedily. A piece after the
    first begins ``overlap`` tokens of the document's encoding before the previous end (less where that would cut
    a character, or where overlap is not below the limit). n_tokens counts the piece encoded on its own and is
    within the limit; only a single character of more tokens than the limit stays whole beyond it. cut_at names the boundary at its end.
    """
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= limit:
        return []
    found = enc.spans(text, limit)
    if found is None:
        return []
    ends, word_starts, before = found
    n = len(ends)
    overlap = max(0, min(overlap, limit - 1))
    # character position of every token index, -1 within a character
    whole = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(whole)])
    places = np.append(0, np.where(np.append(whole, True)[ends], chars[ends], -1))
    at = places.tolist()
    counts = Counts(text, word_starts, before, enc)
    levels = Boundaries(text, places)
    units = _units(levels, n, limit - overlap)
    any_cut = levels[len(LEVELS) - 1]
    pieces, u, begin = [], 0, 0
    while begin < n:
        start = max(0, begin - overlap) if pieces else 0
        start = any_cut[bisect_left(any_cut, start)]
        while u < len(units) and units[u][0] <= begin:
            u += 1
        k = u
        while k + 1 < len(units) and units[k + 1][0] - start <= limit:
            k += 1
        end, mark = units[k]
        count = counts.count(at[start], at[end])
        while count > limit:  # encoded on its own, a piece can need more tokens than in the document
            if k > u:
                k -= 1
                end, mark = units[k]
            else:
                shorter = any_cut[bisect_left(any_cut, end) - 1]
                if shorter > begin:
                    end, mark = shorter, len(LEVELS) - 1
                elif start < begin:
                    start = any_cut[bisect_right(any_cut, start)]
                else:
                    break
            count = counts.count(at[start], at[end])
        pieces.append((start, end, at[start], at[end], count, "end" if end == n else LEVELS[mark]))
        begin = end
    return pieces


def split_documents(documents: DataFrame, settings: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """The pieces of every document with more tokens than its doc_kind allows.

    Columns: doc_id, doc_kind, piece_no (from 1), pieces, token_start, token_end (in the document's encoding),
    shared_tokens (with the piece before), char_start, char_end, n_tokens, cut_at, text.
    Null and empty texts, texts within the limit, and kinds (or null) without a setting, or with one whose
    max_tokens is null or below 1, give no rows. Of several settings of a kind the smallest setting_id holds; a null overlap is 0.
    Repeated rows give their pieces each time. Work is per row; rows move only if the input has fewer partitions than there are cores.
    """
    chosen = settings.where("doc_kind is not null").groupBy("doc_kind").agg(F.min_by(F.struct("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens")), "setting_id").alias("s"))
    limits = chosen.select("doc_kind", "s.max_tokens", "s.overlap_tokens").where("max_tokens >= 1")
    # no text of at most max_tokens bytes has more tokens
    rows = spread(join_lookup(documents.select("doc_id", "doc_kind", "text"), limits, ["doc_kind"]).where("octet_length(text) > max_tokens"), "doc_id", of=documents.select("doc_id"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary, folder)
        names = ["doc_id", "doc_kind", "piece_no", "pieces", "token_start", "token_end", "shared_tokens", "char_start", "char_end", "n_tokens", "cut_at", "text"]
        for pdf in batches:
            out, held = [], 0
            for doc_id, kind, text, limit, overlap in pdf[["doc_id", "doc_kind", "text", "max_tokens", "overlap_tokens"]].itertuples(index=False):
                found = split_text(text, int(limit), int(overlap), enc)
                before = 0
                for i, (ts, te, cs, ce, count, cut_at) in enumerate(found, 1):
                    out.append((doc_id, kind, i, len(found), ts, te, max(0, before - ts), cs, ce, count, cut_at, text[cs:ce]))
                    before = te
                    held += ce - cs
                    if held > 8_000_000:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    id_type = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, doc_kind string, piece_no int, pieces int, token_start int, token_end int, shared_tokens int, char_start int, char_end int, n_tokens int, cut_at string, text string"
    return rows.mapInPandas(pieces, schema)
