"""Mixing sources to target shares of tokens by systematic sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.skew import join_lookup
from ..session import cut, cut_in_place, spread
from .encode import token_count


def document_sizes(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, source and n_tokens of the documents whose source has a target; materialised, as encoding is the cost."""
    wanted = targets.where("source is not null").select("source").distinct()
    mine = spread(join_lookup(documents.select("doc_id", "source", "text"), wanted, ["source"]), "doc_id", of=documents.select("doc_id"))
    return cut(mine.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens")))


def source_plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per target source: target_share, max_repeats, documents, available_tokens, copies (expected per document).

    The mixture is as large as the caps allow while every share is met: the least of
    max_repeats * available_tokens / share over the sources with a share. With ``total_tokens`` it has that size
    and a source that is too small is repeated to its cap and falls short. A source without share or tokens has 0
    copies. If some source has a share but no tokens or no allowed repeats, no size meets all shares; such sources
    are then left out of the minimum and fall short.
    """
    have = sizes.groupBy("source").agg(F.sum(F.when(F.col("n_tokens") > 0, 1).otherwise(0)).cast("long").alias("documents"), F.sum("n_tokens").alias("available_tokens"))
    plan = targets.where("source is not null").select("source", "target_share", "max_repeats").join(have, "source", "left").fillna(0, ["documents", "available_tokens"])
    reach = F.col("max_repeats") * F.col("available_tokens") / F.when(F.col("target_share") > 0, F.col("target_share"))
    total = total_tokens if total_tokens is not None else plan.agg(F.min(F.when(reach > 0, reach)).alias("t")).first()["t"] or 0.0
    copies = F.least(F.col("target_share") * F.lit(float(total)) / F.when(F.col("available_tokens") > 0, F.col("available_tokens")), F.col("max_repeats").cast("double"))
    return plan.withColumn("copies", F.coalesce(copies, F.lit(0.0)))


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers the documents of each source within a partition sorted by source."""
    seen: dict[str, int] = {}
    for pdf in batches:
        base = pdf["source"].map(seen).fillna(0).to_numpy(dtype=np.int64)
        pdf["at"] = base + pdf.groupby("source").cumcount().to_numpy()
        for s, n in pdf["source"].value_counts().items():
            seen[s] = seen.get(s, 0) + int(n)
        yield pdf[["doc_id", "source", "n_tokens", "pid", "at"]]


def sample_copies(sizes: DataFrame, plan: DataFrame, seed: int = 1, turns: int = 1) -> DataFrame:
    """doc_id, source, n_tokens and n_copies (0 or more) of every document with tokens.

    Within a source the expected copies are summed along the documents in order of size (ties by a hash of seed and
    id), shifted by one random offset of the source, and a document gets one copy for each integer that its step
    crosses. Neighbours have nearly equal sizes, so the tokens reached differ from the target by few documents. With
    ``turns`` above 1, of so many evenly spaced turns of the offset the one that comes nearest to the target is taken;
    shares are closer then, but a document's chance is no longer exactly its expected copies.
    The running sum is distributed: documents are range-partitioned by (source, size), numbered within partitions,
    and the partitions' counts (one row per partition and source) are summed ahead of each.
    """
    order = ["source", "n_tokens", "spread", "doc_id"]
    placed = cut_in_place(
        sizes.where("n_tokens > 0")
        .withColumn("spread", F.xxhash64(F.lit(seed), "doc_id"))
        .repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
    ).withColumn("pid", F.spark_partition_id())
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("source", "pid").count().select("source", "pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    schema = f"doc_id {dict(sizes.dtypes)['doc_id']}, source string, n_tokens long, pid int, at long"
    numbered = placed.select("doc_id", "source", "n_tokens", "pid").mapInPandas(_numbered, schema)
    shift = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    joined = join_lookup(join_lookup(numbered, offsets, ["source", "pid"]), plan.select("source", "copies", "available_tokens"), ["source"])
    steps = (cut if turns > 1 else lambda df: df)(joined.select("doc_id", "source", "n_tokens", "copies", "available_tokens", (F.col("at") + F.col("ahead")).cast("double").alias("k")))

    def crossed(offset):
        return (F.floor((F.col("k") + 1) * F.col("copies") + offset) - F.floor(F.col("k") * F.col("copies") + offset)).cast("int")

    if turns == 1:
        return steps.select("doc_id", "source", "n_tokens", crossed(shift).alias("n_copies"))
    turned = [(shift + j / turns) % 1.0 for j in range(turns)]
    reached = steps.groupBy("source").agg(
        F.max(F.col("copies") * F.col("available_tokens")).alias("target"),
        *[F.sum(F.col("n_tokens") * crossed(o)).cast("double").alias(f"t{j}") for j, o in enumerate(turned)],
    )
    options = F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("off"), F.lit(j).alias("j"), o.alias("offset")) for j, o in enumerate(turned)])
    best = cut(reached.select("source", F.array_min(options)["offset"].alias("offset")))
    return join_lookup(steps, best, ["source"]).select("doc_id", "source", "n_tokens", crossed(F.col("offset")).alias("n_copies"))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 1, turns: int = 1) -> DataFrame:
    """The mixture: doc_id, copy_no (from 1), source, n_tokens, text, one row per copy.

    doc_id must be unique. Documents without tokens (null and empty texts) add nothing to any share and are not in
    it; documents of other or null sources are not either. No document has more than max_repeats copies.
    """
    sizes = document_sizes(documents, targets)
    chosen = sample_copies(sizes, cut(source_plan(sizes, targets, total_tokens)), seed, turns).where("n_copies > 0").select("doc_id", "n_tokens", "n_copies")
    rows = documents.select("doc_id", "source", "text").join(chosen, "doc_id")
    return rows.select("doc_id", F.explode(F.sequence(F.lit(1), "n_copies")).alias("copy_no"), "source", "n_tokens", "text")


def reached_shares(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 1, turns: int = 1) -> DataFrame:
    """Per target source: target_share, max_repeats, documents, available_tokens, mixed_documents (distinct),
    mixed_copies, most_copies, mixed_tokens, reached_share (of all mixed tokens; null if the mixture is empty)."""
    sizes = document_sizes(documents, targets)
    plan = cut(source_plan(sizes, targets, total_tokens))
    got = sample_copies(sizes, plan, seed, turns).groupBy("source").agg(
        F.count_if(F.col("n_copies") > 0).alias("mixed_documents"),
        F.sum("n_copies").alias("mixed_copies"),
        F.max("n_copies").cast("long").alias("most_copies"),
        F.sum(F.col("n_tokens") * F.col("n_copies")).alias("mixed_tokens"),
    )
    cols = ["mixed_documents", "mixed_copies", "most_copies", "mixed_tokens"]
    out = cut(plan.join(got, "source", "left").fillna(0, cols))
    total = out.agg(F.sum("mixed_tokens").alias("t")).first()["t"] or 0
    share = F.try_divide(F.col("mixed_tokens").cast("double"), F.lit(float(total)))
    return out.select("source", "target_share", "max_repeats", "documents", "available_tokens", *cols, share.alias("reached_share"))
