"""Records that are equal but for white space, case, punctuation and order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, cut_in_place

_FIELD, _ENTRY, _NULL = "\x01", "\x02", "\x03"


def canonical_text(text: Column) -> Column:
    """Letters and decimal digits only, without regard to case: lower case, with the letters whose upper case is that
    of others written as those (ß as ss, final sigma as sigma, long s as s)."""
    low = F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))
    return F.replace(F.translate(low, "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def canonical_lesson(category: Column, pattern: Column, signature: Column) -> Column:
    """One text that is equal exactly for copies. Separators cannot occur in a canonical text.

    A null signature equals an empty one; a null entry and a null category differ from empty ones.
    """
    null = F.lit(_NULL)
    entries = F.array_sort(F.transform(F.coalesce(signature, F.array().cast("array<string>")), lambda e: F.coalesce(canonical_text(e), null)))
    return F.concat(F.coalesce(canonical_text(category), null), F.lit(_FIELD), canonical_text(pattern), F.lit(_FIELD), F.size(entries).cast("string"), F.lit(_FIELD), F.array_join(entries, _ENTRY))


def _scan(batches: Iterator[pa.RecordBatch], heads: bool) -> Iterator[pa.RecordBatch]:
    """Walks one partition sorted by (key, seq) and compares each key with the one before it.

    Gives (pid, first_seq, seq, head) per row, head telling that the row's run is the partition's first one; or, for
    ``heads``, one row per partition: its first and last key, the seq that begins its last run, and whether it is one run.
    """
    last_key = first_key = None
    run_seq, one_run, any_rows, pid = 0, True, False, 0
    for b in batches:
        if not b.num_rows:
            continue
        key, seq = b.column("key"), b.column("seq").to_numpy(zero_copy_only=False)
        pid = b.column("pid")[0].as_py()
        starts = pa.concat_arrays([pa.array([not any_rows or key[0].as_py() != last_key]), pc.not_equal(key[1:], key[:-1])]).to_numpy(zero_copy_only=False)
        if not any_rows:
            first_key, any_rows = key[0].as_py(), True
            opening = starts.copy()
            opening[0] = False
        else:
            opening = starts
        run = starts.cumsum()
        seqs_of_runs = [run_seq, *seq[starts].tolist()]
        firsts = pa.array([seqs_of_runs[r] for r in run.tolist()], pa.int64())
        head = (opening.cumsum() == 0) & one_run
        one_run = one_run and not opening.any()
        run_seq, last_key = seqs_of_runs[-1], key[-1].as_py()
        if not heads:
            yield pa.RecordBatch.from_arrays([b.column("pid"), firsts, b.column("seq"), pa.array(head)], ["pid", "first_seq", "seq", "head"])
    if heads and any_rows:
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "first_key": [first_key], "last_key": [last_key], "run_seq": pa.array([run_seq], pa.int64()), "one_run": [one_run]})


def runs(keyed: DataFrame) -> DataFrame:
    """first_seq and seq of every row of ``keyed`` (key string, seq long): first_seq is the least seq of the row's key.

    Rows are range-partitioned and externally sorted by (key, seq), so a key with any share of the rows is spread
    over as many partitions as it fills; adjacent full keys are compared, and a run that goes on over partitions is
    carried on from one row per partition (the only thing that the driver sees). Rows without key are left out.
    """
    keyed = cut(keyed.where("key is not null").select("key", "seq"))  # else keys are made once for the ranges, once for the rows
    placed = cut_in_place(keyed.repartitionByRange("key", "seq").sortWithinPartitions("key", "seq")).withColumn("pid", F.spark_partition_id())
    ends = placed.mapInArrow(lambda b: _scan(b, True), "pid int, first_key string, last_key string, run_seq long, one_run boolean")
    carried, last, open_seq = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["pid"]):
        goes_on = last is not None and r["first_key"] == last
        if goes_on:
            carried.append((r["pid"], open_seq))
        if not (goes_on and r["one_run"]):
            open_seq = r["run_seq"]
        last = r["last_key"]
    rows = placed.mapInArrow(lambda b: _scan(b, False), "pid int, first_seq long, seq long, head boolean")
    if not carried:
        return rows.select("first_seq", "seq")
    spark = keyed.sparkSession
    lookup = F.broadcast(spark.createDataFrame(carried, "pid int, carried_seq long"))  # one row per partition at most
    joined = rows.join(lookup, "pid", "left")
    return joined.select(F.when(F.col("head"), F.coalesce("carried_seq", "first_seq")).otherwise(F.col("first_seq")).alias("first_seq"), "seq")


def lesson_runs(lessons: DataFrame) -> DataFrame:
    """first_seq and seq of every lesson with a pattern; rows with a null pattern are never copies and not in it.

    Equal patterns that hold no letter or digit are equal like any others. Texts are compared whole.
    """
    key = canonical_lesson(F.col("category"), F.col("pattern"), F.col("signature"))
    return runs(lessons.where("pattern is not null").select(key.alias("key"), "seq"))


def collapsed(lessons: DataFrame) -> DataFrame:
    """One row per real lesson: first_seq and copies (rows of the group), null patterns each on their own.

    Copies are counted with a map-side combine, so the largest group arrives as one number per task.
    """
    alone = lessons.where("pattern is null").select(F.col("seq").alias("first_seq"), F.lit(1).cast("long").alias("copies"))
    return lesson_runs(lessons).groupBy("first_seq").agg(F.count(F.lit(1)).alias("copies")).unionByName(alone)
