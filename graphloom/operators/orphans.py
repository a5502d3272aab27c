"""References to records that do not exist, were removed, or arrive only later."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, functions as F

from .skew import join_lookup
from ..session import cut

REFERENCE_FIELDS = ("from_id", "from_component", "to_id", "to_component")
FILE_PREFIX = "FILE:"


def missing_keys(keys: DataFrame, ref_cols: Sequence[str], targets: DataFrame, target_cols: Sequence[str], match: str = "simple") -> DataFrame:
    """The rows of ``keys`` whose composite reference has no target row.

    The keys are grouped by the mask of their null columns and every mask is anti-joined on its non-null columns.
    ``match`` states what a partly null reference means:
    ``simple``: it refers to nothing and is never missing; ``partial``: its non-null columns must occur together;
    ``full``: it is always missing. A reference that is null in every column is never missing.
    ``keys`` should hold each key once, so that no group of equal keys can be hot. Extra columns of ``keys`` are kept.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match {match!r}")
    ref_cols, target_cols = list(ref_cols), list(target_cols)
    out = keys.limit(0)
    for mask in product((True, False), repeat=len(ref_cols)):
        used = [(r, t) for r, t, present in zip(ref_cols, target_cols, mask) if present]
        if not used or (match == "simple" and len(used) < len(ref_cols)):
            continue
        part = keys
        for r, present in zip(ref_cols, mask):
            part = part.where(F.col(r).isNotNull() if present else F.col(r).isNull())
        if not (match == "full" and len(used) < len(ref_cols)):
            there = targets.select(*[F.col(t).alias(f"__{r}") for r, t in used]).dropna().distinct()
            condition = None
            for r, _ in used:
                equal = F.col(r) == F.col(f"__{r}")
                condition = equal if condition is None else condition & equal
            part = part.join(there, condition, "left_anti")
        out = out.unionByName(part)
    return out


def references(connections: DataFrame, fields: Sequence[str] = REFERENCE_FIELDS) -> DataFrame:
    """One row per row and distinct non-empty value: seq, repo, value, names (the fields that hold it), times."""
    pairs = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("value")) for f in fields])
    filled = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))
    values = F.array_distinct(F.transform(filled, lambda p: p["value"]))
    packed = F.transform(values, lambda v: F.struct(v.alias("value"), F.transform(F.filter(filled, lambda p: p["value"] == v), lambda p: p["name"]).alias("names")))
    return connections.select("seq", "repo", "detected_at", "arrived_at", F.explode(packed).alias("r")).select("seq", "repo", "detected_at", "arrived_at", "r.value", "r.names")


def orphan_references(connections: DataFrame, components: DataFrame, source_files: DataFrame) -> DataFrame:
    """Every orphan reference of ``connections``: seq, field_name, kind, detected_at, referenced_table.

    A ``FILE:`` value refers to source_files by the composite key (repo, path) with match ``full``: a null repo
    matches nothing. Any other value refers to components.component_id. kind is ``missing``; or ``deleted`` if the
    component's removed_at is not later than detected_at; or ``late`` if its earliest arrival is later than the
    row's arrived_at. Of several removal times the latest holds, and a row without one means not removed. Null and
    empty references are none. A null detected_at or arrived_at decides nothing (not deleted, not late).

    The distinct keys are reduced first (map-side combine) and written once, the anti-joins run over them, and only keys
    that can give an orphan are carried back to the rows by ``join_lookup``: the rows are read twice (a third and fourth
    time to find hot keys if those keys are too many to broadcast).
    """
    refs = references(connections)
    is_file = F.startswith(F.col("value"), F.lit(FILE_PREFIX))
    part = F.when(is_file, F.col("repo")).alias("scope")
    keyed = refs.select("seq", is_file.alias("is_file"), part, "value", "names", "detected_at", "arrived_at")
    # A null-safe text of the scope, so that rows with a null repo can be joined back by equality.
    scope = F.when(F.col("is_file"), F.when(F.col("scope").isNull(), F.lit("n")).otherwise(F.concat(F.lit("r"), "scope"))).otherwise(F.lit("c"))
    keyed = keyed.withColumn("scope_key", scope)
    keys = cut(keyed.groupBy("scope_key", "value").agg(F.max("detected_at").alias("last_detected"), F.min("arrived_at").alias("first_arrived")))
    file_keys = keys.where("scope_key <> 'c'").select(
        "scope_key",
        "value",
        F.when(F.startswith("scope_key", F.lit("r")), F.substring("scope_key", 2, 1 << 30)).alias("repo"),
        F.substring("value", len(FILE_PREFIX) + 1, 1 << 30).alias("path"),
    )
    lost_files = missing_keys(file_keys, ["repo", "path"], source_files, ["repo", "file"], match="full").select("scope_key", "value")
    component_keys = keys.where("scope_key = 'c'")
    known = components.where("component_id is not null").groupBy("component_id").agg(
        F.when(F.count("removed_at") == F.count(F.lit(1)), F.max("removed_at")).alias("removed_at"),
        F.min("arrived_at").alias("component_arrived"),
    )
    lost = missing_keys(component_keys, ["value"], known, ["component_id"])
    doubtful = component_keys.join(known, F.col("value") == F.col("component_id")).where("removed_at <= last_detected or component_arrived > first_arrived")
    none = F.lit(None).cast(dict(components.dtypes)["removed_at"])
    flagged = (
        lost_files.select("scope_key", "value", F.lit(True).alias("gone"), none.alias("removed_at"), none.alias("component_arrived"))
        .unionByName(lost.select("scope_key", "value", F.lit(True).alias("gone"), none.alias("removed_at"), none.alias("component_arrived")))
        .unionByName(doubtful.select("scope_key", "value", F.lit(False).alias("gone"), "removed_at", "component_arrived"))
    )
    hit = join_lookup(keyed.select("seq", "scope_key", "value", "names", "detected_at", "arrived_at"), cut(flagged), ["scope_key", "value"])
    kind = F.when(F.col("gone"), "missing").when(F.col("removed_at") <= F.col("detected_at"), "deleted").when(F.col("component_arrived") > F.col("arrived_at"), "late")
    target = F.when(F.col("scope_key") == "c", "components").otherwise("source_files")
    return (
        hit.select("seq", F.explode("names").alias("field_name"), kind.alias("kind"), "detected_at", target.alias("referenced_table"))
        .where("kind is not null")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per referenced table, month of detected_at, field and kind (month null where detected_at is)."""
    month = F.date_format("detected_at", "yyyy-MM").alias("month")
    return orphans.groupBy("referenced_table", month, "field_name", "kind").agg(F.count(F.lit(1)).alias("orphans"))
