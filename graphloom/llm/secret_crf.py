"""A linear-chain conditional random field over lexical tokens; its Viterbi path tells which tokens are secret."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np

from .secret_lexer import CANDIDATES, KIND, kind_of, lex
from .secret_training import TRAINING_LINES, training_texts

FEATURE_BITS = 17
_MASK = (1 << FEATURE_BITS) - 1
_NEWLINE = KIND["newline"]
_WEAK = np.array([KIND[k] for k in ("identifier", "dotted", "path", "constant", "uuid", "hyphenated")])
_GLUE = np.array([KIND[k] for k in ("operator", "at", "number", "word", "assign", "dollar", "other", "identifier", "version")])
_NAMES = np.array([KIND[k] for k in ("secret_word", "strong_word")])
_CUES = np.array([KIND[k] for k in ("secret_word", "strong_word", "public_word", "reference_word")])
_SOFT = np.array([KIND[k] for k in ("word", "number", "version", "secret_word", "strong_word", "public_word", "identifier", "dotted", "path", "constant", "uuid", "hyphenated", "host", "other")])
_CANDIDATE = np.zeros(len(KIND), bool)
_CANDIDATE[list(CANDIDATES)] = True
_IS = {k: KIND[k] for k in KIND}
#: Distinct tokens whose kind is kept by a worker; beyond that the table starts anew.
TABLE_LIMIT = 400_000


class TokenTable:
    """Kind, word and length class of each distinct token."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.rows: list[tuple[int, int, int]] = []
        self.array = np.zeros((0, 3), np.int64)

    def number(self, tokens: list[str]) -> list[int]:
        ids, rows = self.ids, self.rows
        out = []
        for t in tokens:
            i = ids.get(t)
            if i is None:
                i = ids[t] = len(rows)
                kind = KIND[kind_of(t)]
                literal = _CANDIDATE[kind] and kind not in (_IS["identifier"], _IS["dotted"], _IS["path"])
                # literals are known by their kind, words by a hash of their lower-case text
                word = kind if literal else 64 + (crc32(t.lower().encode("utf-8", "surrogatepass")) & 0xFFFFFF)
                rows.append((kind, word, min(7, int(np.log2(len(t) + 1)))))
            out.append(i)
        return out

    def lookup(self, numbers: np.ndarray) -> np.ndarray:
        if len(self.array) != len(self.rows):
            self.array = np.array(self.rows, np.int64).reshape(-1, 3)
        return self.array[numbers]


@dataclass
class Batch:
    """Tokens of many texts, flat: text number, token start and end, kind, word, length class, gap before it."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    word: np.ndarray
    size: np.ndarray
    line: np.ndarray


def tokenize(texts: list[str], table: TokenTable) -> Batch:
    if len(table.rows) > TABLE_LIMIT:
        table.__init__()
    numbers: list[int] = []
    starts: list[int] = []
    ends: list[int] = []
    counts = []
    for t in texts:
        tokens, at = lex(t)
        numbers += table.number(tokens)
        starts += at
        ends += [a + len(x) for a, x in zip(at, tokens)]
        counts.append(len(tokens))
    text = np.repeat(np.arange(len(texts)), counts)
    k, w, s = table.lookup(np.array(numbers, np.int64)).T if numbers else np.zeros((3, 0), np.int64)
    breaks = np.ones(len(text), bool)
    if len(text):
        breaks[1:] = (text[1:] != text[:-1]) | (k[:-1] == _NEWLINE)
    return Batch(text, np.array(starts, np.int64), np.array(ends, np.int64), k, w, s, np.cumsum(breaks) - 1)


def _near(values: np.ndarray, text: np.ndarray, offset: int, missing: int) -> np.ndarray:
    """The value ``offset`` tokens away in the same text."""
    out = np.full(len(values), missing, np.int64)
    if abs(offset) < len(values):
        a, b = (slice(-offset, None), slice(None, offset)) if offset < 0 else (slice(None, -offset), slice(offset, None))
        same = text[a] == text[b]
        out[a] = np.where(same, values[b], missing)
    return out


def _mix(tag: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), 0x9E3779B1 * (tag + 1) & 0x7FFFFFFF, np.int64)
    for p in parts:
        h = (h ^ p) * 0x5BD1E995 & 0x7FFFFFFFFFFF
        h ^= h >> 17
    return (h & _MASK).astype(np.int32)


def _before(mask: np.ndarray) -> np.ndarray:
    """The place of the last marked token before each token, -1 for none."""
    at = np.where(mask, np.arange(len(mask)), -1)
    return np.concatenate([[-1], np.maximum.accumulate(at)[:-1]]) if len(mask) else at


def _line_starts(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: where its line begins, and where the line before it in the same text begins (its own if none)."""
    first = np.searchsorted(b.line, b.line, "left")
    last = np.maximum(first - 1, 0)
    return first, np.where((first > 0) & (b.text[last] == b.text), first[last], first) if len(first) else first


def _in_quotes(b: Batch, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an odd number of quotes stands before a token in its line, and the place of the last of them."""
    quote = b.kind == _IS["quote"]
    n = np.cumsum(quote) - quote
    return ((n - n[first]) % 2 == 1) & ~quote, _before(quote)


def features(b: Batch, rows: np.ndarray | None = None) -> np.ndarray:
    """Hashed features of tokens (tokens x templates): shape, neighbours and the line's naming words.

    ``rows`` (a mask) limits the result to some tokens; their context is read from all.
    """
    k, w, t = b.kind, b.word, b.text
    rows = slice(None) if rows is None else rows
    none = len(KIND)
    k1, k2, k3 = (_near(k, t, -i, none) for i in (1, 2, 3))
    n1, n2 = _near(k, t, 1, none), _near(k, t, 2, none)
    w1, w2, w3 = (_near(w, t, -i, 0) for i in (1, 2, 3))
    x1 = _near(w, t, 1, 0)
    at = np.arange(len(k))
    cue_at = np.where(np.isin(k, _CUES), at, -1)
    before = np.concatenate([[-1], np.maximum.accumulate(cue_at)[:-1]]) if len(k) else cue_at
    first = np.searchsorted(b.line, b.line, "left")
    known = before >= first
    cue = np.where(known, k[before], none)
    cue_word = np.where(known, w[before], 0)
    gap = np.where(known, np.minimum(5, np.log2(np.maximum(1, at - before)).astype(np.int64)), 6)
    strong_at = np.where((k == _IS["strong_word"]) | (k == _IS["secret_word"]), at, -1)
    s_before = np.concatenate([[-1], np.maximum.accumulate(strong_at)[:-1]]) if len(k) else strong_at
    strong = np.where(s_before >= first, k[s_before] + 1, 0)
    lines = int(b.line[-1]) + 1 if len(k) else 0
    has = lambda name: (np.bincount(b.line, weights=k == _IS[name], minlength=lines) > 0)[b.line].astype(np.int64)
    public, strongs, reference = has("public_word"), has("strong_word"), has("reference_word")
    quoted = (k1 == _IS["quote"]).astype(np.int64) * 2 + (n1 == _IS["quote"])
    inside, opened = _in_quotes(b, first)
    opener = np.where(inside, k1[opened], none + 1) if len(k) else k1  # what stands before the opening quote, and its name
    named = np.where(inside, w2[opened], 0) if len(k) else w2
    inner = inside & (s_before > opened)  # the naming word is quoted too, as in a message
    above = np.where((s_before < first) & (s_before >= _line_starts(b)[1]), 1 + np.minimum(3, first - s_before), 0)
    place = np.minimum(3, at - first)
    own = w
    (k, k1, k2, k3, n1, n2, w1, w2, w3, x1, cue, cue_word, gap, strong, public, strongs, reference, quoted, size, inside, opener, named, inner, above, place, own) = (
        a[rows] for a in (k, k1, k2, k3, n1, n2, w1, w2, w3, x1, cue, cue_word, gap, strong, public, strongs, reference, quoted, b.size, inside.astype(np.int64), opener, named, inner.astype(np.int64), above, place, own)
    )
    templates = [
        (np.zeros(len(k), np.int64),),
        (k,),
        (k, size),
        (k, k1),
        (k, k1, k2),
        (k, n1),
        (k, k1, n1),
        (k, n1, n2),
        (k, cue, gap),
        (k, cue_word),
        (k, w1),
        (k, w2),
        (k, w3),
        (k, public, strong),
        (k, strongs, reference, quoted),
        (k, x1),
        (k1, k2, k3),
        (cue, gap),
        (cue_word, k1),
        (w1, w2),
        (k, cue, k1, quoted),
        (own,),
        (k, inside, opener, strong, inner),
        (k, inside, named),
        (k, above, place, k1),
        (k, k1, n1, strong),
    ]
    return np.stack([_mix(i, *parts) for i, parts in enumerate(templates)], 1)


def allowed(b: Batch) -> np.ndarray:
    """Tokens that may be secret at all: literals; words, names and numbers that follow a word for credentials in their
    line or the line before, that are quoted or assigned in a line with such a word, or that are the password of an
    address; and marks inside one of these (no white space around) or, up to two, right before one that is assigned."""
    k1, n1 = _near(b.kind, b.text, -1, len(KIND)), _near(b.kind, b.text, 1, len(KIND))
    first, above = _line_starts(b)
    lines = int(b.line[-1]) + 1 if len(b.line) else 0
    names = np.isin(b.kind, _NAMES)
    named = (np.bincount(b.line, weights=names, minlength=lines) > 0)[b.line]
    given = np.isin(k1, [_IS["quote"], _IS["assign"]]) | (b.kind == _IS["hyphenated"]) | _in_quotes(b, first)[0]
    follows = _before(names) >= above
    address = (k1 == _IS["assign"]) & (n1 == _IS["at"])
    soft = np.isin(b.kind, _SOFT) & (follows | given & named | address)
    candidate = _CANDIDATE[b.kind] & ~np.isin(b.kind, _WEAK) | soft
    touch = _near(b.end, b.text, -1, -1) == b.start
    glue = np.isin(b.kind, _GLUE) & touch & (_near(b.start, b.text, 1, -1) == b.end)
    beside = _near(candidate.astype(np.int64), b.text, -1, 0) + _near(candidate.astype(np.int64), b.text, 1, 0)
    mark = (b.kind == _IS["operator"]) & (_near(b.start, b.text, 1, -1) == b.end)
    leads = mark & _near(candidate.astype(bool), b.text, 1, 0).astype(bool)
    leads |= mark & _near(leads, b.text, 1, 0).astype(bool)
    leads &= np.isin(k1, [_IS["quote"], _IS["assign"]]) | _near(leads, b.text, -1, 0).astype(bool)
    return candidate | leads | glue & (beside >= np.where(b.kind == _IS["dollar"], 2, 1))  # a dollar before a name is a reference


def _steps(line: np.ndarray):
    """For lines of different length: the tokens at each step of all lines at once, longest lines first."""
    starts = np.flatnonzero(np.diff(line, prepend=-1))
    lengths = np.diff(np.append(starts, len(line)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    steps = []
    for s in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -s, "left"))
        steps.append(starts[:n] + s)
    return steps


def viterbi(score: np.ndarray, may: np.ndarray, trans: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The best label of every token (True: secret). ``score`` is the secret label's score, the other's is 0."""
    n = len(score)
    s = np.where(may, score, -1e9)
    back = np.zeros((n, 2), np.int8)
    steps = _steps(line)
    label = np.zeros(n, np.int8)
    if not steps:
        return label.astype(bool)
    a = np.stack([np.zeros(len(steps[0])), s[steps[0]]], 1)
    last = [None] * len(steps)
    for i, now in enumerate(steps[1:], 1):
        last[i - 1] = a[len(now) :].argmax(1)
        a = a[: len(now)]
        to0, to1 = a + trans[:, 0], a + trans[:, 1]
        back[now, 0], back[now, 1] = to0.argmax(1), to1.argmax(1)
        a = np.stack([to0.max(1), to1.max(1) + s[now]], 1)
    last[len(steps) - 1] = a.argmax(1)
    for i in range(len(steps) - 1, -1, -1):
        now = steps[i]
        ended = len(last[i])
        if ended:
            label[now[len(now) - ended :]] = last[i]
        if i + 1 < len(steps):
            later = steps[i + 1]
            label[now[: len(later)]] = back[later, label[later]]
    return label.astype(bool)


def _marginals(score, may, trans, line):
    """P(secret) of each token, and the expected transition counts, by forward and backward sums."""
    s = np.where(may, score, -50.0)
    steps = _steps(line)
    n = len(s)
    f, g = np.zeros((n, 2)), np.zeros((n, 2))
    f[steps[0]] = np.stack([np.zeros(len(steps[0])), s[steps[0]]], 1)
    for before, now in zip(steps, steps[1:]):
        a = f[before[: len(now)]]
        f[now, 0] = np.logaddexp(a[:, 0] + trans[0, 0], a[:, 1] + trans[1, 0])
        f[now, 1] = np.logaddexp(a[:, 0] + trans[0, 1], a[:, 1] + trans[1, 1]) + s[now]
    expected = np.zeros((2, 2))
    for before, now in zip(steps[-2::-1], steps[:0:-1]):
        e = np.stack([np.zeros(len(now)), s[now]], 1) + g[now]
        b = before[: len(now)]
        for i in (0, 1):
            g[b, i] = np.logaddexp(trans[i, 0] + e[:, 0], trans[i, 1] + e[:, 1])
    total = np.logaddexp((f + g)[:, 0], (f + g)[:, 1])
    for before, now in zip(steps, steps[1:]):
        b = before[: len(now)]
        e = np.stack([np.zeros(len(now)), s[now]], 1) + g[now]
        for i in (0, 1):
            for j in (0, 1):
                expected[i, j] += np.exp(f[b, i] + trans[i, j] + e[:, j] - total[b]).sum()
    return np.exp((f + g)[:, 1] - total), expected


@dataclass
class Field:
    weights: np.ndarray
    trans: np.ndarray

    def label(self, b: Batch) -> np.ndarray:
        may = allowed(b)
        busy = np.zeros(int(b.line[-1]) + 1 if len(b.line) else 0, bool)
        busy[b.line[may]] = True
        out = np.zeros(len(b.kind), bool)
        keep = busy[b.line]  # a line without a token that may be secret has only one labelling
        if keep.any():
            score = np.zeros(len(b.kind))
            score[may] = self.weights[features(b, may)].sum(1)
            out[keep] = viterbi(score[keep], may[keep], self.trans, b.line[keep])
        return out


def gold(b: Batch, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    y = np.zeros(len(b.kind), bool)
    first = np.searchsorted(b.text, np.arange(len(spans) + 1))
    for i, own in enumerate(spans):
        s = slice(first[i], first[i + 1])
        for lo, hi in own:
            y[s] |= (b.start[s] < hi) & (b.end[s] > lo)
    return y


def train(lines: int = TRAINING_LINES, seed: int = 7, rounds: int = 60, rate: float = 0.25, l2: float = 0.4) -> Field:
    """Weights by gradient ascent (Adagrad, all lines in every round) on the likelihood of the generated labels."""
    sample = training_texts(lines, seed)
    b = tokenize([t for t, _ in sample], TokenTable())
    y = gold(b, [s for _, s in sample])
    may = allowed(b)
    busy = np.zeros(int(b.line[-1]) + 1, bool)
    busy[b.line[may]] = True
    keep = busy[b.line]  # lines without a token that may be secret have one labelling only and teach nothing
    x = features(b, may)
    y, may, line = (y & may)[keep], may[keep], b.line[keep]
    score = np.zeros(len(y))
    weights, trans = np.zeros(1 << FEATURE_BITS), np.zeros((2, 2))
    pairs = line[1:] == line[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][pairs].astype(int), y[1:][pairs].astype(int)), 1)
    g2, t2 = np.full(len(weights), 1e-6), np.full((2, 2), 1e-6)
    flat = x.ravel()
    for _ in range(rounds):
        score[may] = weights[x].sum(1)
        p, expected = _marginals(score, may, trans, line)
        grad = np.bincount(flat, weights=np.repeat((y - p)[may], x.shape[1]), minlength=len(weights)) - l2 * weights
        tgrad = seen - expected - l2 * trans
        g2 += grad**2
        t2 += tgrad**2
        weights += rate * grad / np.sqrt(g2)
        trans += rate * tgrad / np.sqrt(t2)
    return Field(weights.astype(np.float32), trans)


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field with its standard training, once per process."""
    return train()
