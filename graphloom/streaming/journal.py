"""Append-only journals as streams: reading, folding per key, drift state, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.audit import EWMA_LAMBDA, EWMA_WARMUP, EWMA_WIDTH

JOURNAL_SCHEMA = "ts timestamp, op string, actor string, slug string, locked boolean, delta long, summary string"


def read_journal(spark: SparkSession, path: str, schema: str = JOURNAL_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """A journal folder as a stream; torn and malformed lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_journal_once(spark: SparkSession, path: str, schema: str = JOURNAL_SCHEMA) -> DataFrame:
    """The same folder as a batch, rotated generations included."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tail(journal: DataFrame, limit: int, op: str | None = None, actor: str | None = None) -> DataFrame:
    """The newest ``limit`` records after the filters, oldest first (a top-k, never a full sort)."""
    kept = journal
    if op is not None:
        kept = kept.where(F.col("op") == op)
    if actor is not None:
        kept = kept.where(F.col("actor") == actor)
    return kept.orderBy(F.desc("ts"), F.desc("slug")).limit(limit).orderBy("ts", "slug")


FOLD_SCHEMA = "slug string, scans long, changes long, first_seen timestamp, last_seen timestamp, status string"
_FOLD_STATE = "scans long, changes long, first_us long, last_us long, status string"


def fold_batch(journal: DataFrame) -> DataFrame:
    """Memory of each project: scans, significant changes, first and last record, removed or active by the last one."""
    last = F.max_by("op", F.struct("ts", "op"))
    return journal.where("slug is not null").groupBy("slug").agg(
        F.count_if(F.col("op") == "project.scanned").alias("scans"), F.count_if(F.col("op") == "architecture.changed").alias("changes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.when(last == "project.removed", "removed").otherwise("active").alias("status"),
    )


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    scans, changes, first, last, status = state.get if state.exists else (0, 0, None, None, "active")
    for pdf in batches:
        pdf = pdf.sort_values(["ts", "op"])
        scans += int((pdf["op"] == "project.scanned").sum())
        changes += int((pdf["op"] == "architecture.changed").sum())
        us = pdf["ts"].astype("datetime64[us]").astype("int64")
        first = int(us.min()) if first is None else min(first, int(us.min()))
        if last is None or int(us.max()) >= last:
            last, status = int(us.max()), "removed" if pdf["op"].iloc[-1] == "project.removed" else "active"
    state.update((scans, changes, first, last, status))
    yield pd.DataFrame([(key[0], scans, changes, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), status)], columns=["slug", "scans", "changes", "first_seen", "last_seen", "status"])


def fold_stream(journal: DataFrame) -> DataFrame:
    """``fold_batch`` kept up to date: one updated row per project and micro-batch, state in the state store."""
    rows = journal.where("slug is not null and ts is not null").select("slug", "ts", "op")
    return rows.groupBy("slug").applyInPandasWithState(_fold, FOLD_SCHEMA, _FOLD_STATE, "update", GroupStateTimeout.NoTimeout)


DRIFT_SCHEMA = "stratum string, n long, z double, limit double, breach boolean"
_DRIFT_STATE = "n long, mean double, m2 double, z double"


def _drift(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, mean, m2, z = state.get if state.exists else (0, 0.0, 0.0, 0.0)
    out = []
    for pdf in batches:
        for x in pdf.sort_values("at")["rate"]:
            n += 1
            limit = 0.0
            if n <= EWMA_WARMUP:
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
            else:
                z = EWMA_LAMBDA * (x - mean) + (1 - EWMA_LAMBDA) * z
                limit = EWMA_WIDTH * max(m2 / EWMA_WARMUP, 1e-12) ** 0.5 * (EWMA_LAMBDA / (2 - EWMA_LAMBDA) * (1 - (1 - EWMA_LAMBDA) ** (2 * (n - EWMA_WARMUP)))) ** 0.5
            out.append((key[0], n, z if n > EWMA_WARMUP else 0.0, limit, n > EWMA_WARMUP and abs(z) > limit))
    state.update((n, mean, m2, z))
    yield pd.DataFrame(out, columns=["stratum", "n", "z", "limit", "breach"])


def drift_stream(rates: DataFrame) -> DataFrame:
    """Drift chart of a stream of rates (stratum, at, rate), one row per rate; the state survives between runs."""
    return rates.select("stratum", "at", "rate").groupBy("stratum").applyInPandasWithState(_drift, DRIFT_SCHEMA, _DRIFT_STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Counts per tumbling window and key with a watermark (our addition): late rows within ``lateness`` count."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), key, "events")
