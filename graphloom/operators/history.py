"""Snapshots over time, file changes, versions, freshness and scan modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .graph_views import clean_path
from .skew import join_lookup
from .snapshot_cells import snapshot_sequence

#: Package types and critical layers of the significance rules.
PACKAGE_TYPES = ("npm", "pip", "spm", "cargo", "go", "gem", "composer")
CRITICAL_LAYERS = ("database", "infra")
#: Files whose change forces a full scan, the cap of incremental scans and the age of a full one in hours.
FULL_SCAN_FILES = ("package.json", "requirements.txt", "pyproject.toml", "Cargo.toml", "Package.swift", "schema.prisma", "docker-compose.yml", "vercel.json")
INCREMENTAL_CAP, FULL_SCAN_HOURS, SCHEMA_VERSION = 20, 7 * 24, "1.1.0"


def snapshot_pairs(snapshots: DataFrame) -> DataFrame:
    """Each component of a snapshot pair with its state before and after: snapshot_id, component_id, before, after.

    before or after is null where the component is absent; of several rows the latest delivered_at holds.
    """
    cols = ["version", "status", "layer", "critical", "component_type"]
    rows = snapshots.where("snapshot_id is not null").select("snapshot_id", "component_id", F.struct("delivered_at", "seq").alias("at"), F.struct(*cols).alias("v")).groupBy("snapshot_id", "component_id").agg(F.max_by("v", "at").alias("v"))
    placed = join_lookup(rows, cut(snapshot_sequence(snapshots)), ["snapshot_id"])
    sides = F.array(F.struct(F.when(F.col("previous_id").isNotNull(), F.col("snapshot_id")).alias("at"), F.lit(True).alias("after")), F.struct(F.col("next_id").alias("at"), F.lit(False).alias("after")))
    rows = placed.select("component_id", "v", F.explode(sides).alias("s")).where("s.at is not null")
    return rows.groupBy(F.col("s.at").alias("snapshot_id"), "component_id").agg(F.max(F.when(F.col("s.after"), F.col("v"))).alias("after"), F.max(F.when(~F.col("s.after"), F.col("v"))).alias("before"))


def version_part(version: Column, part: int) -> Column:
    """Number ``part`` (1 to 3) of a version a.b.c after any leading non-digits; null if there is none."""
    return F.expr("try_cast(null as int)") if part not in (1, 2, 3) else F.nullif(F.regexp_extract(version, r"^[^0-9]*([0-9]+)\.([0-9]+)\.([0-9]+)", part), F.lit("")).try_cast("long")


def version_key(version: Column) -> Column:
    """The numbers of a version, missing ones as 0, so that 10.0.0 comes after 9.0.0; null for null."""
    p = r"^[^0-9]*([0-9]+)(?:[.]([0-9]+))?(?:[.]([0-9]+))?"
    return F.when(version.isNotNull(), F.array(*[F.coalesce(F.nullif(F.regexp_extract(version, p, k), F.lit("")).try_cast("long"), F.lit(0).cast("long")) for k in (1, 2, 3)]))


def bump_class(before: Column, after: Column) -> Column:
    """major, minor or patch; unparseable versions count as minor."""
    a, b = [version_part(before, i) for i in (1, 2)], [version_part(after, i) for i in (1, 2)]
    return F.when(a[0].isNull() | b[0].isNull(), "minor").when(b[0] > a[0], "major").when(b[1] > a[1], "minor").otherwise("patch")


def significance(snapshots: DataFrame) -> DataFrame:
    """Grade of every snapshot after its repo's first: snapshot_id, counts, triggers (sorted, joined), significance.

    Triggers: layer-change, high-churn (over a fifth), new-layer (an added layer that nothing was removed from, as the
    reference computes it), new-package, version-bump (another major number), metadata-only.
    """
    p = snapshot_pairs(snapshots)
    added, removed = F.col("before").isNull(), F.col("after").isNull()
    both = ~added & ~removed
    changed = both & ~(F.col("before").eqNullSafe(F.col("after")))
    layer = F.coalesce(F.when(added, F.col("after.layer")).when(removed, F.col("before.layer")), F.lit(""))
    major = changed & (version_part(F.col("before.version"), 1) != version_part(F.col("after.version"), 1))
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = p.groupBy("snapshot_id").agg(
        F.count_if(added).alias("added"), F.count_if(removed).alias("removed"), F.count_if(changed).alias("modified"), F.count_if(~added).alias("before"),
        flag((added | removed) & layer.isin(*CRITICAL_LAYERS)).alias("l"), flag(added & F.col("after.component_type").isin(*PACKAGE_TYPES)).alias("p"), flag(major).alias("v"),
        F.collect_set(F.when(added, layer)).alias("in"), F.collect_set(F.when(removed, layer)).alias("out"),
    )
    total = F.col("added") + F.col("removed") + F.col("modified")
    churn = total / F.greatest(F.col("before"), F.lit(1)) > 0.2
    fresh = (F.size("in") > 0) & (F.col("before") > 0) & (F.size(F.array_except("in", "out")) > 0)
    named = [("layer-change", F.col("l")), ("high-churn", churn), ("new-layer", fresh), ("new-package", F.col("p")), ("version-bump", F.col("v"))]
    triggers = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))
    triggers = F.when((F.size(triggers) == 0) & (total > 0), F.array(F.lit("metadata-only"))).otherwise(triggers)
    grade = F.when(F.col("l") | churn | fresh, "major").when(F.col("p") | F.col("v"), "minor").otherwise("patch")
    return per.select("snapshot_id", "added", "removed", "modified", F.array_join(F.array_sort(triggers), ",").alias("triggers"), grade.alias("significance"))


def timeline(snapshots: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` newest snapshots of each repo: repo, position (1 is newest), snapshot_id, taken_at, components."""
    heads = snapshots.where("snapshot_id is not null").select("repo", "snapshot_id", "taken_at", "component_id").distinct().groupBy("repo", "snapshot_id", "taken_at").agg(F.count("component_id").alias("components"))
    order = Window.partitionBy("repo").orderBy(F.desc("taken_at"), F.desc("snapshot_id"))
    return heads.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("repo", "position", "snapshot_id", "taken_at", "components")


def first_seen(snapshots: DataFrame) -> DataFrame:
    """When each component was first and last in a snapshot, and in how many."""
    return snapshots.where("component_id is not null").groupBy("component_id").agg(F.min("taken_at").alias("first_seen"), F.max("taken_at").alias("last_seen"), F.countDistinct("snapshot_id").alias("snapshots"))


def state_at(snapshots: DataFrame, moment: str) -> DataFrame:
    """The components of each repo's newest snapshot at ``moment``, counted: repo, snapshot_id, components, active."""
    past = snapshots.where(F.col("taken_at") <= F.lit(moment).cast(dict(snapshots.dtypes)["taken_at"]))
    newest = past.groupBy("repo").agg(F.max_by("snapshot_id", F.struct("taken_at", "snapshot_id")).alias("snapshot_id"))
    rows = past.groupBy("repo", "snapshot_id", "component_id").agg(F.max_by("status", F.struct("delivered_at", "seq")).alias("status"))
    return rows.join(newest, ["repo", "snapshot_id"]).groupBy("repo", "snapshot_id").agg(F.count(F.lit(1)).alias("components"), F.count_if(F.col("status") == "active").alias("active"))


def version_bumps(snapshots: DataFrame) -> DataFrame:
    """Version changes between consecutive snapshots by class: bump, changes."""
    p = snapshot_pairs(snapshots).where("before is not null and after is not null and not (before.version <=> after.version) and after.version is not null")
    return p.groupBy(bump_class(F.col("before.version"), F.col("after.version")).alias("bump")).agg(F.count(F.lit(1)).alias("changes"))


def file_changes(source_files: DataFrame, moment: str) -> DataFrame:
    """Files whose newest scan at ``moment`` differs from their newest scan at all: repo, path, change.

    added (no scan by then), modified (another content) or unchanged; a file whose newest content is null counts as
    removed. Contents are compared by SHA-256; a null content has none.
    """
    t = dict(source_files.dtypes)["scanned_at"]
    old = F.col("scanned_at") <= F.lit(moment).cast(t)
    digest = F.sha2(F.encode("content", "UTF-8"), 256)
    s = F.struct(F.struct("scanned_at", "file_id").alias("at"), digest.alias("h"))
    g = source_files.where("file is not null").groupBy("repo", clean_path(F.col("file")).alias("path")).agg(F.max(F.when(old, s)).alias("a"), F.max(s).alias("b"))
    change = F.when(F.col("b.h").isNull() & F.col("a.h").isNotNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a.h").eqNullSafe(F.col("b.h")), "unchanged").otherwise("modified")
    return g.select("repo", "path", change.alias("change"))


def freshness(nodes: DataFrame, latest: DataFrame, as_of: str, window_days: int = 7) -> DataFrame:
    """Freshness of each external package against ``latest`` (name, component_type, latest_version, checked_at).

    unresolved (not listed or never checked), stale (an older version is installed; with its bump), drifting (the check
    is older than the window) or current. A null installed version is never stale. component_id, freshness, bump.
    """
    packages = nodes.where(F.col("component_type").isin(*PACKAGE_TYPES)).select("component_id", "name", "component_type", "version")
    j = packages.join(latest, ["name", "component_type"], "left")
    overdue = F.col("checked_at") < F.lit(as_of).cast(dict(latest.dtypes)["checked_at"]) - F.expr(f"interval {window_days} days")
    newer = F.coalesce(version_key(F.col("latest_version")) > version_key(F.col("version")), F.lit(False))
    state = F.when(F.col("checked_at").isNull(), "unresolved").when(newer, "stale").when(overdue, "drifting").otherwise("current")
    return j.select("component_id", state.alias("freshness"), F.when(state == "stale", bump_class(F.col("version"), F.col("latest_version"))).alias("bump"))


def scan_modes(state: DataFrame) -> DataFrame:
    """The scan that each repo needs, by the first reason that holds: repo, mode, reason.

    ``state``: repo, flag (full, incremental, auto or null), has_index, schema_version, drift_breach, added (long),
    changed (array of paths, added ones included), full_scan_age_hours (null if never), incrementals.
    """
    trigger = F.exists("changed", lambda f: f.isin(*FULL_SCAN_FILES) | F.element_at(F.split(f, "/"), -1).isin(*FULL_SCAN_FILES))
    has = F.coalesce("has_index", F.lit(False))
    rules = [
        (F.col("flag").eqNullSafe("full"), "full", "flag-full"),
        (~has, "full", "no-prior-state"),
        (F.col("flag").eqNullSafe("incremental"), "incremental", "flag-incremental"),
        (~F.coalesce("schema_version", F.lit("1.0.0")).isin("1.0.0", SCHEMA_VERSION), "full", "schema-mismatch"),
        (F.coalesce("drift_breach", F.lit(False)), "full", "audit-drift-breach"),
        (F.coalesce(trigger, F.lit(False)), "full", "manifest-changed"),
        (F.coalesce(F.col("added") > 0, F.lit(False)), "full", "new-files"),
        (F.coalesce(F.col("full_scan_age_hours") > FULL_SCAN_HOURS, F.lit(False)), "full", "stale-full"),
        (F.coalesce(F.col("incrementals") >= INCREMENTAL_CAP, F.lit(False)), "full", "incremental-cap"),
        (F.coalesce(F.size("changed") == 0, F.lit(True)) | F.col("changed").isNull(), "incremental", "no-changes"),
        (F.lit(True), "incremental", "fast-path"),
    ]
    out = None
    for cond, mode, reason in rules:
        v = F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"))
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return state.select("repo", out.alias("v")).select("repo", "v.mode", "v.reason")


def owner_and_repo(url: Column) -> Column:
    """owner/repo of a hosted repository's address, or null."""
    return F.nullif(F.regexp_extract(url, r"(?i)(?:github|gitlab|bitbucket)\.(?:com|org)[/:]([^/\s]+/[^/.\s]+)", 1), F.lit(""))
