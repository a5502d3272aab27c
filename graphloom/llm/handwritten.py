"""Telling hand-written source files from generated, minified, copied and pure-data ones."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import spread

STATISTICS = ("lines", "max_line", "mean_line", "space_share", "alnum_share", "number_density", "encoded_share", "skeleton_share", "logic_density", "comment_share", "literal_share")


@dataclass(frozen=True)
class Limits:
    """Thresholds of one language, outside what people write in it.

    White space, letters and digits among the other characters, and line shapes are what differs most by language
    (indentation, braces, marks, derived attributes). The thresholds of white space lie 0.01 to 0.02 below the least
    among 32,600 hand-written test files; those of letters and digits lie far outside these (0.75 to 0.90), where all
    but 32 of 2,540 published source files of Python and TypeScript are too.
    """

    long_line: float = 120.0  # minified code has a line longer than this ...
    dense_line: float = 100.0  # ... and lines of this mean length, or is packed
    packed_space: float = 0.093  # white space of packed code
    alnum_low: float = 0.62  # letters and digits among all that is not white space
    alnum_high: float = 0.94
    number_density: float = 0.6  # words that begin with a digit
    encoded_share: float = 0.5  # characters inside long encoded runs
    skeleton_share: float = 0.83  # code lines that follow the three commonest line shapes
    logic_density: float = 0.004  # words of program logic in pure data
    has_logic: bool = True  # whether the language has program logic at all, so that its absence says something


#: Tuned per language; a null or other language takes the default, which is the loosest.
LIMITS: dict[str | None, Limits] = {
    "javascript": Limits(packed_space=0.097, alnum_low=0.68, alnum_high=0.92),
    "typescript": Limits(packed_space=0.099, alnum_low=0.68, alnum_high=0.92),
    "python": Limits(packed_space=0.093, alnum_low=0.62, alnum_high=0.94),
    "rust": Limits(packed_space=0.096, alnum_low=0.68, alnum_high=0.92, skeleton_share=0.87),
    "swift": Limits(packed_space=0.165, alnum_low=0.71, alnum_high=0.92),
    "css": Limits(packed_space=0.11, alnum_low=0.0, alnum_high=1.0, number_density=0.75, has_logic=False),  # hardly a hand-written one to measure
}

#: A table has this many numbers, repeated code this many lines, a payload this many words: fewer are no pattern.
TABLE_NUMBERS, SKELETON_LINES, PAYLOAD_WORDS = 12, 12, 24
#: Files in which comments have this share are judged by their comments' head only; data has less than the second.
COMMENTED, UNCOMMENTED = 0.5, 0.03

_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
_ALNUM_BYTES = bytes(b for b in range(128) if chr(b).isalnum())
_SHAPE_BYTES = bytes(57 if 48 <= b < 58 else 119 if b >= 128 or chr(b).isalpha() or b == 95 else b for b in range(256))
_RUN = regex.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{64,}+|(?:\\x[0-9A-Fa-f]{2}){12,}+|(?:0x[0-9A-Fa-f]{1,8},?\s*){12,}+|(?:\\u[0-9A-Fa-f]{4}){10,}+")
_STRING = regex.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_NAME_SHAPE, _NUMBER_SHAPE = re.compile(rb"w[w9]+"), re.compile(rb"9[w9]+")
_COMMENT = regex.compile(r"(?://|(?<![\w&])\#(?![0-9a-fA-F]{3,8}\b))[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"", regex.S)
# Statements that only bring in or pass on names, over all their lines.
_IMPORT = re.compile(r"^[ \t]*(?:(?:import|from|use|pub use|mod|pub mod|#include)[ \t{*](?:[^\n({]*(?:\([^)]*\)|\{[^}]*\}))?|export (?:type )?(?:\*|\{[^}]*\})).*$|^__all__\s*\+?=\s*[\[(][^\])]*[\])]", re.M)
# Words of program logic over the languages.
_LOGIC = frozenset(
    b"if else for while return function def fn func class import from use async await switch match try catch struct impl trait interface enum type throw raise lambda yield new var mod extension protocol".split()
)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _words(text: str) -> list[bytes]:
    """Runs of letters, digits and underscores."""
    return _bytes(text).translate(_WORD_BYTES).split()


def layout(text: str) -> dict[str, float]:
    """Layout statistics of a whole text; all zero for an empty one. Line shapes are those of the code without comments and imports."""
    n = len(text)
    if not n:
        return dict.fromkeys(STATISTICS, 0.0)
    lines = text.splitlines() or [""]
    parts = text.split()
    bare = _COMMENT.sub(" ", text)
    naked = _STRING.sub("''", bare)
    words, code = _words(bare), _words(naked)
    shaped = _NUMBER_SHAPE.sub(b"9", _NAME_SHAPE.sub(b"w", _bytes(_IMPORT.sub("", naked)).translate(_SHAPE_BYTES)))
    shapes = Counter(filter(None, map(bytes.strip, shaped.splitlines())))
    alnum = len(text.encode("ascii", "ignore")) - len(text.encode("ascii", "ignore").translate(None, _ALNUM_BYTES))
    if not text.isascii():
        alnum += sum(c.isalnum() for c in text if c > "\x7f")
    # a run is unbroken by white space, or made of escapes
    runs = any(len(p) >= 64 for p in parts) or "0x" in text
    return {
        "lines": float(sum(1 for x in lines if x and not x.isspace())),
        "max_line": float(max(map(len, lines))),
        "mean_line": n / len(lines),
        "space_share": 1 - sum(map(len, parts)) / n,
        "alnum_share": alnum / max(1, sum(map(len, parts))),
        "number_density": sum(48 <= w[0] < 58 for w in words) / max(1, len(words)),
        "encoded_share": sum(m.end() - m.start() for m in _RUN.finditer(text)) / n if runs else 0.0,
        "skeleton_share": sum(c for _, c in shapes.most_common(3)) / max(SKELETON_LINES, shapes.total()),
        "logic_density": (sum(w in _LOGIC for w in code) + naked.count("=>")) / max(1, len(words)),
        "comment_share": 1 - len(bare.strip()) / max(1, len(text.strip())) if bare != text else 0.0,
        "literal_share": 1 - len(naked) / max(1, len(bare)),
    }


def machine_layout(s: dict[str, float], words: int, language: str | None) -> str | None:
    """What the statistics show by the language's thresholds. By the measures of layout itself: minified, packed (without
    long lines), encoded, table, marks (letters and digits rarer or more frequent than people write); then, as additions,
    repeated (line shapes) and data (no logic); or None."""
    lim = LIMITS.get((language or "").lower(), Limits())
    if not s["lines"]:
        return None
    packed = s["space_share"] < lim.packed_space and s["comment_share"] < COMMENTED
    if s["max_line"] > lim.long_line and (packed or s["mean_line"] > lim.dense_line):
        return "minified"
    if packed and words >= PAYLOAD_WORDS:
        return "packed"
    if s["encoded_share"] > lim.encoded_share:
        return "encoded"
    if s["comment_share"] < UNCOMMENTED and s["number_density"] > lim.number_density and s["number_density"] * words >= TABLE_NUMBERS:
        return "table"
    if s["comment_share"] < COMMENTED and words >= PAYLOAD_WORDS and not lim.alnum_low <= s["alnum_share"] <= lim.alnum_high:
        return "marks"
    if not lim.has_logic:
        return None
    if s["comment_share"] < COMMENTED and s["skeleton_share"] > lim.skeleton_share:
        return "repeated"
    if s["comment_share"] < UNCOMMENTED and s["logic_density"] < lim.logic_density and words >= PAYLOAD_WORDS and (s["number_density"] > 0.2 or s["literal_share"] > 0.3):
        return "data"
    return None


_HEADER = regex.compile(r"\s*(?:(?:(?://|\#|--|;)[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|\"\"\".*?(?:\"\"\"|\Z))\s*)++", regex.S)
_QUOTED = regex.compile(r"'[^'\n]{2,80}'|\"[^\"\n]{2,80}\"|`[^`\n]{2,80}`|“[^”\n]{2,80}”")
# How generators of several languages sign their output.
_GENERATED = regex.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\b|\bgenerated (?:automatically )?by\b|\bgenerated (?:code|file|from)\b|\bdo not (?:edit|modify|change)\b|\b(?:emitted|produced|created|written) (?:automatically )?by \S+ from\b"
    r"|\bproduced automatically\b|\bmachine output of\b|\boutput, do not\b|\bregenerate with\b|\bmanual (?:changes|edits) will be (?:lost|overwritten)\b|\bedits are overwritten\b"
    r"|\bwurde von \S+ (?:erzeugt|generiert|erstellt)\b|\bautomatisch (?:erzeugt|generiert)\b|\bnicht von hand ändern\b|\b(?:créé|généré)e? automatiquement\b|\bne pas modifier\b|\bgenerado (?:automáticamente|por)\b|\bno (?:editar|modificar)\b",
    regex.I,
)
_BY_HAND = regex.compile(r"\bmaintained by hand\b|\bwritten by hand\b|\bsince then written\b|\bno longer generated\b|\bnot generated\b|\bkeep (?:it|them) sorted by hand\b|\bvon hand gepflegt\b|\bécrit à la main\b", regex.I)
_LICENCE = regex.compile(r"\b(?:MIT|Apache(?:-2\.0| License)|BSD(?:-\d-Clause)?|ISC|MPL(?:-2\.0)?|[AL]?GPL(?:-\d(?:\.\d)?)?|Unlicense|Zlib|CC0|EPL-\d)\b|@licen[cs]e\b|\breleased under\b", regex.I)
_VERSION = regex.compile(r"(?:\bv|@|\b)\d+\.\d+(?:\.\d+)?\b")
_UPSTREAM = regex.compile(r"\bupstream\b|\b(?:copied|vendored|taken|imported|bundled) from\b|\(c\) the \S+ (?:contributors|authors|project)|\bcopyright \(c\).*(?:contributors|authors)|@licen[cs]e \S+ \d", regex.I)


def stated_origin(text: str) -> str | None:
    """What the comment at the top of the file states: generated, other_project, or None.

    Only comments before the first line of code count, and not what they quote.
    """
    m = _HEADER.match(text.removeprefix("﻿"))
    if not m:
        return None
    head = _QUOTED.sub(" ", m.group())
    if _BY_HAND.search(head):
        return None
    if _GENERATED.search(head):
        return "generated"
    if _UPSTREAM.search(head) and (_LICENCE.search(head) or _VERSION.search(head)) or _LICENCE.search(head) and _VERSION.search(head):
        return "other_project"
    return None


SHINGLE_WORDS = 5
#: A copy shares at least this part of one file's shingles, and this part of the other's ("also if lightly altered").
COPY_SHARE, COPY_OTHER_SHARE = 0.5, 0.3
#: Texts with fewer shingles than this are copies if all their words are the same, in order.
COPY_SHINGLES = 12
#: Package texts are compared in blocks of at most this many characters, each broadcast in turn.
PACKAGE_BLOCK_CHARS = 32 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of all runs of five words; equal within one process only."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(h) - SHINGLE_WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i, f in enumerate(_FACTORS):
        mixed = (mixed ^ (h[i : i + n] * f)) * _FACTORS[0]
        mixed ^= mixed >> np.uint64(29)
    return mixed


class PackageIndex:
    """Shingles of known package files, built in the process that compares with them."""

    def __init__(self, files: list[tuple[int, str]]):
        self.size: dict[int, int] = {}
        self.short: dict[tuple[bytes, ...], int] = {}
        keys, items = [], []
        for item, text in files:
            words = _words(text.lower())
            own = np.unique(shingles(words))
            self.size[item] = len(own)
            if len(own) < COPY_SHINGLES:
                if len(words) >= SHINGLE_WORDS:
                    self.short[tuple(words)] = min(item, self.short.get(tuple(words), item))
                continue
            keys.append(own)
            items.append(np.full(len(own), item, np.int64))
        keys, items = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *items])
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]

    def copy_of(self, text: str) -> tuple[int | None, float]:
        """The package file of which the text is a copy, and the larger shared part."""
        words = _words(text.lower())
        own = shingles(words)
        if len(own) >= COPY_SHINGLES and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            if np.count_nonzero(self.keys[at] == own) < COPY_SHINGLES:
                return None, 0.0
        own = np.unique(own)
        if len(own) < COPY_SHINGLES:
            item = self.short.get(tuple(words))
            return item, 0.0 if item is None else 1.0
        lo = np.searchsorted(self.keys, own, "left")
        hi = np.searchsorted(self.keys, own, "right")
        hit = np.flatnonzero(hi > lo)
        shared = Counter(self.items[np.concatenate([np.arange(x, y) for x, y in zip(lo[hit].tolist(), hi[hit].tolist())])].tolist()) if len(hit) else {}
        best, share = None, 0.0
        for item, n in sorted(shared.items()):
            a, b = n / len(own), n / self.size[item]
            if n >= COPY_SHINGLES and max(a, b) >= COPY_SHARE and min(a, b) >= COPY_OTHER_SHARE and max(a, b) > share:
                best, share = item, max(a, b)
        return best, share


def file_evidence(source_files: DataFrame, package_files: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``source_files``.

    Columns: file_id, the layout statistics, layout (what they show), origin (what the header states), package_item
    (the package file it copies), package_share, machine_made. Null and empty contents have zero statistics and are
    not machine-made. Rows are judged where they are read; package_files, a small fixed table, is brought to the
    driver in blocks of bounded size, each broadcast to its own pass over the rows.
    """
    spark = source_files.sparkSession
    known = package_files.where("content <> ''").select(F.col("item_id").cast("long").alias("i"), "content").repartitionByRange(1, "i")
    blocks: list[list[tuple[int, str]]] = [[]]
    held = 0
    for r in known.toLocalIterator():
        if held + len(r["content"]) > PACKAGE_BLOCK_CHARS and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((r["i"], r["content"]))
        held += len(r["content"])
    names = ["file_id", *STATISTICS, "layout", "origin", "package_item", "package_share"]
    types = [pa.int64(), *[pa.float64()] * len(STATISTICS), pa.string(), pa.string(), pa.int64(), pa.float64()]
    schema = "file_id long, " + ", ".join(f"{s} double" for s in STATISTICS) + ", layout string, origin string, package_item long, package_share double"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in names}
            for file_id, lang, content in zip(b.column("file_id").to_pylist(), b.column("code_lang").to_pylist(), b.column("content").to_pylist()):
                text = content or ""
                s = layout(text)
                for c, v in zip(names, [file_id, *(s[k] for k in STATISTICS), machine_layout(s, len(_words(text)), lang), stated_origin(text), None, 0.0]):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(out[c], t) for c, t in zip(names, types)], b.column("content")], [*names, "content"])

    def compare(files: list[tuple[int, str]]):
        sent = spark.sparkContext.broadcast(files)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = PackageIndex(sent.value)
            for b in batches:
                items, shares = [], []
                for content, item, share in zip(b.column("content").to_pylist(), b.column("package_item").to_pylist(), b.column("package_share").to_pylist()):
                    other, part = index.copy_of(content or "")
                    better = other is not None and part > share
                    items.append(other if better else item)
                    shares.append(part if better else share)
                fixed = [b.column(c) for c in names[:-2]]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(items, pa.int64()), pa.array(shares, pa.float64()), b.column("content")], [*names, "content"])

        return run

    first = spread(source_files.select(F.col("file_id").cast("long").alias("file_id"), "code_lang", "content"), "file_id").mapInArrow(judge, schema + ", content string")
    for block in blocks:
        if block:
            first = first.mapInArrow(compare(block), schema + ", content string")
    first = first.drop("content")
    return first.withColumn("machine_made", F.coalesce("layout", "origin", F.col("package_item").cast("string")).isNotNull())


def group_counts(partition_groups: DataFrame, source_files: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per repo: files, machine-made files, and the sum of suspect_vendored that its groups report (from paths only).

    Both sides are reduced to one row per repo before they meet. A null repo is a row of its own.
    """
    judged = evidence.select("file_id", "machine_made")
    files = source_files.select("file_id", "repo").join(judged, "file_id").groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.count_if("machine_made").alias("machine_made"))
    told = partition_groups.groupBy("repo").agg(F.sum("suspect_vendored").alias("suspect_vendored"))
    return files.join(told, files["repo"].eqNullSafe(told["repo"]), "left").select(files["repo"], "files", "machine_made", F.coalesce("suspect_vendored", F.lit(0)).alias("suspect_vendored"))
