"""Finding credentials in code and prompts, and masking exactly their characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import spread
from . import secret_crf
from .secret_lexer import KIND, key_material

MASK = "REDACTED"
_PEM = KIND["pem_private"]
#: Characters of text that are labelled at once by a worker; bounds its memory, not the texts.
BLOCK_CHARS = 4_000_000


def spans_of(texts: list[str], field: secret_crf.Field, table: secret_crf.TokenTable) -> list[list[tuple[int, int]]]:
    """Character spans of the credentials of each text, in order; adjoining secret tokens are one span, marks alone are none."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    block, held = [], 0
    groups = []
    for i, t in enumerate(texts):
        block.append(i)
        held += len(t)
        if held > BLOCK_CHARS:
            groups.append(block)
            block, held = [], 0
    for group in [*groups, block]:
        if not group:
            continue
        b = secret_crf.tokenize([texts[i] for i in group], table)
        for k in np.flatnonzero(field.label(b)):
            i = group[b.text[k]]
            lo, hi = int(b.start[k]), int(b.end[k])
            own = out[i]
            if b.kind[k] == _PEM:
                own.extend(key_material(texts[i], lo, hi))
            elif own and own[-1][1] == lo:
                own[-1] = (own[-1][0], hi)
            else:
                own.append((lo, hi))
    return [[(lo, hi) for lo, hi in own if any(map(str.isalnum, t[lo:hi]))] for t, own in zip(texts, out)]


def masked(text: str, spans: list[tuple[int, int]], mask: str = MASK) -> str:
    """The text with each span replaced by ``mask``, all else unchanged."""
    parts, at = [], 0
    for lo, hi in spans:
        parts += [text[at:lo], mask]
        at = hi
    return "".join([*parts, text[at:]])


def credential_rows(rows: DataFrame, key_cols: list[str], text_col: str = "text", mask: str = MASK) -> DataFrame:
    """The rows of ``rows`` whose text holds a credential: the key columns, span_starts, span_ends, masked_text.

    Null and empty texts have none. Texts are read whole; repeated rows come out each. The trained weights
    (2**17 numbers) are broadcast; rows are labelled where they are read, and move only if the input has fewer
    partitions than there are cores.
    """
    spark = rows.sparkSession
    trained = secret_crf.trained()
    weights = spark.sparkContext.broadcast((trained.weights, trained.trans))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in key_cols) + ", span_starts array<int>, span_ends array<int>, masked_text string"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, table = secret_crf.Field(*weights.value), secret_crf.TokenTable()
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            spans = spans_of(texts, field, table)
            hit = [i for i, s in enumerate(spans) if s]
            if not hit:
                continue
            take = pa.array(hit)
            keys = [batch.column(c).take(take) for c in key_cols]
            starts = pa.array([[lo for lo, _ in spans[i]] for i in hit], pa.list_(pa.int32()))
            ends = pa.array([[hi for _, hi in spans[i]] for i in hit], pa.list_(pa.int32()))
            clean = pa.array([masked(texts[i], spans[i], mask) for i in hit], pa.string())
            yield pa.RecordBatch.from_arrays([*keys, starts, ends, clean], [*key_cols, "span_starts", "span_ends", "masked_text"])

    return spread(rows.select(*key_cols, text_col).where(f"`{text_col}` <> ''"), *key_cols).mapInArrow(label, schema)


def searched_rows(connections: DataFrame, llm_calls: DataFrame, prompts: DataFrame) -> DataFrame:
    """table_name, seq and text of every row of the three tables."""
    parts = [("connections", connections, "code"), ("llm_calls", llm_calls, "prompt_template"), ("prompts", prompts, "content")]
    out = None
    for name, df, col in parts:
        one = df.select(F.lit(name).alias("table_name"), F.col("seq").cast("long").alias("seq"), F.col(col).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out
