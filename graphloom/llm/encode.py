"""Encoding a corpus with a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import spread
from .bpe import DEFAULT_VOCABULARY, TOKENIZER_DIR, encoder


def token_ids(text: Column, vocabulary: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_DIR) -> Column:
    """Ids of each text as array<int>; an empty array for null and empty texts."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder(vocabulary, folder).encode
        flat: list[int] = []
        ends = [0]
        for t in texts.to_pylist():
            flat += encode(t)
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))

    return ids(text)


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_DIR) -> Column:
    """Number of tokens of each text as long; 0 for null and empty texts."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        n = encoder(vocabulary, folder).count
        return pa.array([n(t) for t in texts.to_pylist()], pa.int64())

    return count(text)


def token_text(ids: Column, vocabulary: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_DIR) -> Column:
    """The text of ids; null for null, an empty text for none."""

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        decode = encoder(vocabulary, folder).decode
        return pa.array([None if x is None else decode(x) for x in lists.to_pylist()], pa.string())

    return text(ids)


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id_col`` and ``ids``, one row per row of ``documents``, repeated rows included.

    Encoding is per row; rows move only if the input has fewer partitions than there are cores. Null and empty texts have an empty list; other columns are not read.
    """
    return spread(documents.select(id_col, text_col), id_col).select(F.col(id_col), token_ids(F.col(text_col), vocabulary, folder).alias("ids"))
