"""What changed between consecutive full snapshots, by signed key-field-value cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .skew import join_lookup
from ..session import cut

PRESENCE = "\x00present"


def snapshot_sequence(snapshots: DataFrame) -> DataFrame:
    """One row per snapshot: snapshot_id, previous_id, next_id within its repo, ordered by taken_at, then id.

    The repo's order is over snapshots, not records; a null repo is a repo of its own.
    """
    heads = snapshots.where("snapshot_id is not null").groupBy("snapshot_id").agg(F.min("repo").alias("repo"), F.min("taken_at").alias("taken_at"))
    order = Window.partitionBy("repo").orderBy("taken_at", "snapshot_id")
    return heads.select("snapshot_id", F.lag("snapshot_id").over(order).alias("previous_id"), F.lead("snapshot_id").over(order).alias("next_id"))


def snapshot_changes(snapshots: DataFrame, fields: Sequence[str] = ("version", "status")) -> DataFrame:
    """Changes of each snapshot against the one before it in its repo.

    Columns: snapshot_id, component_id, change_kind (added, removed, changed), changed_fields (the fields of
    ``fields`` that differ, sorted and joined with a comma; empty for added and removed).

    Method: each record gives +1 to its own snapshot's comparison and -1 to the following snapshot's, as one cell
    per field and value and one cell for its presence; groups whose sum is not zero are the differences. Null values
    are values (null equals null). Of several rows of a component in a snapshot the one with the latest delivered_at
    holds (ties: the largest seq). A null component_id is a key of its own; rows without snapshot_id belong to no
    snapshot. The first snapshot of a repo gives no rows, an empty table none either.
    """
    fields = list(fields)
    rows = (
        snapshots.where("snapshot_id is not null")
        .select("snapshot_id", "component_id", F.struct("delivered_at", "seq").alias("at"), F.struct(*fields).alias("v"))
        .groupBy("snapshot_id", "component_id")
        .agg(F.max_by("v", "at").alias("v"))
    )
    sequence = cut(snapshot_sequence(snapshots))
    placed = join_lookup(rows, sequence, ["snapshot_id"])
    sides = F.array(
        F.struct(F.when(F.col("previous_id").isNotNull(), F.col("snapshot_id")).alias("at"), F.lit(1).alias("sign")),
        F.struct(F.col("next_id").alias("at"), F.lit(-1).alias("sign")),
    )
    signed = placed.select("component_id", "v", F.explode(sides).alias("s")).where("s.at is not null")
    cells = F.array(
        F.struct(F.lit(PRESENCE).alias("field"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(f).alias("field"), F.col(f"v.{f}").cast("string").alias("value")) for f in fields],
    )
    # One exchange on (snapshot, component) serves both groupings below; no such pair has more than 2 records here.
    unpivoted = signed.select(F.col("s.at").alias("snapshot_id"), "component_id", "v", F.col("s.sign").alias("sign")).repartition("snapshot_id", "component_id")
    unpivoted = unpivoted.select("snapshot_id", "component_id", "sign", F.explode(cells).alias("c")).select("snapshot_id", "component_id", "sign", "c.field", "c.value")
    sums = unpivoted.groupBy("snapshot_id", "component_id", "field", "value").agg(F.sum("sign").alias("total")).where("total <> 0")
    marks = sums.groupBy("snapshot_id", "component_id").agg(
        F.sum(F.when(F.col("field") == PRESENCE, F.col("total")).otherwise(0)).alias("presence"),
        F.array_sort(F.collect_set(F.when(F.col("field") != PRESENCE, F.col("field")))).alias("changed"),
    )
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return marks.select(
        "snapshot_id",
        "component_id",
        kind.alias("change_kind"),
        F.when(F.col("presence") == 0, F.concat_ws(",", "changed")).otherwise("").alias("changed_fields"),
    )


def change_report(changes: DataFrame) -> DataFrame:
    """Counts per snapshot and kind: snapshot_id, added, removed, changed."""
    n = lambda kind: F.count_if(F.col("change_kind") == kind).alias(kind)
    return changes.groupBy("snapshot_id").agg(n("added"), n("removed"), n("changed"))
