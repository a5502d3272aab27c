"""Reports over the graph, its history and its sources: manifest, roll-ups, comparisons, audits, filters and remaps."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .audit import AQL_PLANS, aql_plan, cochran
from .catalog import VENDOR_SEGMENTS
from .extract import addresses, env_category
from .graph_views import clean_path, ends
from .history import PACKAGE_TYPES, snapshot_pairs
from .skew import join_lookup
from .traverse import _in_package_folder

#: Hosts by the lower-case name of an infra component, with parts of names and types that run on them.
HOSTS = {
    "railway": (("bullmq", "redis", "pg", "postgres"), ("database", "queue", "service")), "vercel": (("next", "next.js", "nextjs"), ("framework", "service")),
    "heroku": (("redis", "pg", "postgres"), ("database", "queue", "service")), "render": (("redis", "pg", "postgres"), ("database", "queue", "service")),
}
HOSTED_LAYERS = ("queue", "database", "backend", "frontend")
#: Limits of a pattern of paths.
GLOB_LENGTH, GLOB_DEEP = 256, 8
#: Fixed value: a definition of an environment variable.
ENV_DEFINITION = r"(?m)^[ \t]*(?:export[ \t]+)?([A-Z_][A-Z0-9_]*)[ \t]*="


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows of each key by ``order``, with their position: each of 256 parts of a key keeps its own first
    ones before they meet, so that a hot key is never sorted as a whole."""
    keys = list(keys)
    part = df.withColumn("__part", F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(256)))
    best = part.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))).where(F.col("__r") <= k)
    return best.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= k).select(*df.columns, "position")


def manifest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The derived manifest: section (components, connections), key (a type, or total), items."""
    total = lambda df, name: df.groupBy().agg(F.count(F.lit(1)).alias("items")).select(F.lit(name).alias("section"), F.lit("total").alias("key"), "items")
    by = lambda df, name, c: df.groupBy(F.coalesce(c, F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("items")).select(F.lit(name).alias("section"), "key", "items")
    return total(nodes, "components").unionByName(by(nodes, "components", "component_type")).unionByName(total(edges, "connections")).unionByName(by(edges, "connections", "connection_type"))


def snapshot_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges as a snapshot keeps them, with the names of their ends, ? where one is unknown."""
    named = ends(edges, nodes, columns=("name",))
    return named.select("connection_id", "from_id", "to_id", "connection_type", F.coalesce("from_name", F.lit("?")).alias("from_name"), F.coalesce("to_name", F.lit("?")).alias("to_name"), "file")


def community_rollup(labels: DataFrame, ranks: DataFrame, top: int = 5) -> DataFrame:
    """Per community: members, rank (sum of its members' ranks, to 6 places), best (ids of the ``top`` of highest rank, in
    order). Members without a rank count 0."""
    rows = labels.select("component_id", "community").join(ranks, "component_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    sums = rows.groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.round(F.sum("rank"), 6).alias("rank"))
    best = top_rows(rows, ["community"], [F.desc("rank"), "component_id"], top).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "component_id"))), lambda x: x["component_id"]), ",").alias("best"))
    return sums.join(best, "community").select("community", "members", "rank", "best")


def premerge_diff(snapshots: DataFrame, baseline: DataFrame, branch: DataFrame) -> DataFrame:
    """What a branch's snapshot changes against the canonical one: repo, available, added, removed, changed.

    ``baseline`` and ``branch`` name one snapshot_id per repo. A repo without a baseline is not available, and its counts
    are null. A component changed if its version or status did; of several rows of one the latest delivered holds.
    """
    rows = snapshots.groupBy("snapshot_id", "component_id").agg(F.max_by(F.struct("version", "status"), F.struct("delivered_at", "seq")).alias("v"))
    side = lambda df, name: join_lookup(rows, df.select("repo", "snapshot_id"), ["snapshot_id"]).select("repo", "component_id", F.struct("v").alias(name))
    both = side(baseline, "a").join(side(branch, "b"), ["repo", "component_id"], "full")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    counts = both.groupBy("repo").agg(F.count_if(b & ~a).alias("added"), F.count_if(a & ~b).alias("removed"), F.count_if(a & b & ~F.col("a.v").eqNullSafe(F.col("b.v"))).alias("changed"))
    known = branch.select("repo").join(baseline.select("repo", F.lit(True).alias("available")), "repo", "left").select("repo", F.coalesce("available", F.lit(False)).alias("available"))
    shown = lambda c: F.when(F.col("available"), F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    return known.join(counts, "repo", "left").select("repo", "available", shown("added"), shown("removed"), shown("changed"))


def diff_guard(snapshots: DataFrame) -> DataFrame:
    """Whether each snapshot's difference adds up: snapshot_id, before, after, added, removed, consistent."""
    p = snapshot_pairs(snapshots)
    a, b = F.col("before").isNotNull(), F.col("after").isNotNull()
    g = p.groupBy("snapshot_id").agg(F.count_if(a).alias("before"), F.count_if(b).alias("after"), F.count_if(b & ~a).alias("added"), F.count_if(a & ~b).alias("removed"))
    return g.withColumn("consistent", F.col("before") + F.col("added") - F.col("removed") == F.col("after"))


def refresh_report(fresh: DataFrame, nodes: DataFrame) -> DataFrame:
    """Freshness of packages counted by type and bump: component_type, freshness, bump (null unless stale), packages."""
    kinds = nodes.where(F.col("component_type").isin(*PACKAGE_TYPES)).select("component_id", "component_type")
    return fresh.join(kinds, "component_id").groupBy("component_type", "freshness", "bump").agg(F.count(F.lit(1)).alias("packages"))


def model_access(calls: DataFrame) -> DataFrame:
    """Readers and writers of each mapped model: model, files, readers, writers, both (files that only read, only write,
    and do both). ``calls``: rows of ``extract.orm_calls``."""
    is_ = lambda name: F.count_if(F.col("label") == name)
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("files"), is_("reads").alias("readers"), is_("writes").alias("writers"), is_("reads+writes").alias("both"))


def env_usage(rows: DataFrame, code: str, references: DataFrame) -> DataFrame:
    """Environment variables that are defined in texts, referenced, or both: name, category, defined, referenced (texts),
    state. Only names are taken from definitions, never values. ``references``: name, rows."""
    defined = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(code, F.lit(ENV_DEFINITION), F.lit(1)))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("defined"))
    j = defined.join(references.select("name", F.col("rows").alias("referenced")), "name", "full")
    zero = F.lit(0).cast("long")
    state = F.when(F.col("referenced").isNull(), "unused").when(F.col("defined").isNull(), "undefined").otherwise("used")
    return j.select("name", env_category(F.col("name")).alias("category"), F.coalesce("defined", zero).alias("defined"), F.coalesce("referenced", zero).alias("referenced"), state.alias("state"))


def resource_topology(edges: DataFrame) -> DataFrame:
    """Kinds of resources that addresses in code name: resource, endpoints (distinct host and port), targets (distinct to_id)."""
    found = addresses(edges.where("code is not null"), "connection_id", "code").join(edges.select("connection_id", "to_id"), "connection_id")
    per = found.groupBy("resource", "host", F.coalesce("port", F.lit(0)).alias("port")).agg(F.count(F.lit(1)).alias("n"))
    ends_ = per.groupBy("resource").agg(F.count(F.lit(1)).alias("endpoints"), F.sum("n").alias("mentions"))
    return ends_.join(found.groupBy("resource").agg(F.countDistinct("to_id").alias("targets")), "resource").select("resource", "endpoints", "mentions", "targets")


def remap_ids(edges: DataFrame, prior: DataFrame, current: DataFrame) -> DataFrame:
    """Edges with ends of an earlier scan led to the components that have the same stable id now: connection_id, from_id,
    to_id, remapped (ends that changed).

    ``prior`` and ``current``: component_id, stable_id. FILE: ends, unknown ends and those whose stable id is gone stay.
    Of several current components of a stable id the smallest holds.
    """
    now = current.where("stable_id is not null").groupBy("stable_id").agg(F.min("component_id").alias("now"))
    lead = prior.where("stable_id is not null").groupBy("component_id").agg(F.min("stable_id").alias("stable_id")).join(now, "stable_id").where("component_id <> now")
    side = lambda c: lead.select(F.col("component_id").alias(c), F.col("now").alias(f"{c}_now"))
    j = join_lookup(join_lookup(edges, side("from_id"), ["from_id"], "left"), side("to_id"), ["to_id"], "left")
    moved = lambda c: F.col(f"{c}_now").isNotNull().cast("int")
    return j.select("connection_id", F.coalesce("from_id_now", "from_id").alias("from_id"), F.coalesce("to_id_now", "to_id").alias("to_id"), (moved("from_id") + moved("to_id")).alias("remapped"))


def hosting(nodes: DataFrame) -> DataFrame:
    """Components that an infra component of their repo probably runs, by parts of names: host_id, component_id.

    Few names of hosts are known; each is a filter of its own, and hosts meet components by repo and name of the host.
    """
    hosts = nodes.where((F.col("layer") == "infra") & F.lower("name").isin(*HOSTS)).select(F.col("component_id").alias("host_id"), "repo", F.lower("name").alias("host"))
    fits = F.array_compact(F.array(*[F.when(F.col("component_type").isin(*types) & F.lower("name").rlike("|".join(map(re.escape, names))), F.lit(host)) for host, (names, types) in HOSTS.items()]))
    mine = nodes.where(F.col("layer").isin(*HOSTED_LAYERS)).select("component_id", "repo", F.explode(fits).alias("host"))
    return mine.join(hosts, ["repo", "host"]).where("host_id <> component_id").select("host_id", "component_id")


def glob_pattern(glob: str) -> str:
    """A path pattern as a regular expression: ** any folders, * and ? within one; other marks stand for themselves."""
    if len(glob) > GLOB_LENGTH or glob.count("**") > GLOB_DEEP:
        raise ValueError(f"a pattern has at most {GLOB_LENGTH} characters and {GLOB_DEEP} times **")
    meaning = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(meaning.get(m) or re.sub(r"[.+^${}()|\[\]\\]", r"\\\g<0>", m) for m in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob)) + "$"


def mappable(nodes: DataFrame, exclude: Sequence[str] = (), include_vendored: bool = False) -> DataFrame:
    """Code components with what a map makes of them: component_id, verdict (excluded, vendored, suspect or kept).

    Excluded are those whose path fits a pattern, vendored those in a vendor folder; suspect ones lie in a folder of
    packages below the name of a known package, and are kept.
    """
    path = clean_path(F.coalesce("file", F.lit("")))
    out = path.rlike("|".join(map(glob_pattern, exclude))) if exclude else F.lit(False)
    vendored = F.lit(not include_vendored) & F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_SEGMENTS)))
    suspect = _in_package_folder(nodes).withColumn("suspect", F.lit(True))
    rows = nodes.where("component_type = 'component'").join(suspect, "component_id", "left")
    return rows.select("component_id", F.when(out, "excluded").when(vendored, "vendored").when(F.col("suspect"), "suspect").otherwise("kept").alias("verdict"))


def plan_choice(lots: DataFrame) -> DataFrame:
    """The audit plan of each lot: repo, plan, n, c. A forced plan (``plan``) holds; after a breach Cochran; with at least
    three audits before SPRT; else AQL. ``lots``: repo, lot, plan (or null), breach, prior."""
    kind = F.coalesce("plan", F.when(F.coalesce("breach", F.lit(False)), "Cochran").when(F.col("prior") >= 3, "SPRT").otherwise("AQL"))
    planned = aql_plan(lots.select("repo", "lot", kind.alias("plan")))
    full = F.coalesce(*[F.when(F.col("code_letter") == letter, F.lit(n).cast("long")) for _, letter, n, _ in AQL_PLANS])
    is_cochran = F.col("plan") == "Cochran"
    return planned.select("repo", "plan", F.when(is_cochran, cochran(0.05, 0.05, F.col("lot"))).otherwise(full).alias("n"), F.when(is_cochran, 0).otherwise(F.col("accept")).alias("c"))


def stale_files(source_files: DataFrame, moment: str) -> DataFrame:
    """Files whose content at the scan of ``moment`` is no longer theirs: repo, path, reason (missing or hash mismatch).

    Recorded is the newest scan up to the moment; a file that was not scanned by then is not stale. A null content now
    means that the file is gone.
    """
    kind = dict(source_files.dtypes)["scanned_at"]
    s = F.struct(F.struct("scanned_at", "file_id").alias("at"), F.sha2(F.encode("content", "UTF-8"), 256).alias("h"))
    g = source_files.where("file is not null").groupBy("repo", clean_path(F.col("file")).alias("path")).agg(F.max(F.when(F.col("scanned_at") <= F.lit(moment).cast(kind), s)).alias("a"), F.max(s).alias("b"))
    reason = F.when(F.col("b.h").isNull(), "missing").when(F.col("a.h") != F.col("b.h"), "hash mismatch")
    return g.where("a.h is not null").select("repo", "path", reason.alias("reason")).where("reason is not null")


def audit_report(checks: dict[str, tuple[DataFrame, DataFrame]], lot: int) -> DataFrame:
    """One row per class of defect and one for all: class, checked, defects, rate, verdict (of all: accept if no more
    defects than the lot's acceptance number). ``checks``: what was checked and what failed, by class."""
    out = None
    for name, (population, failed) in checks.items():
        one = population.groupBy().agg(F.count(F.lit(1)).alias("checked")).join(failed.groupBy().agg(F.count(F.lit(1)).alias("defects"))).select(F.lit(name).alias("class"), "checked", "defects")  # one row each
        out = one if out is None else out.unionByName(one)
    accept = next(c for top, _, _, c in AQL_PLANS if top is None or lot <= top)
    total = out.groupBy().agg(F.sum("checked").alias("checked"), F.sum("defects").alias("defects")).select(F.lit("all").alias("class"), "checked", "defects")
    verdict = F.when(F.col("class") == "all", F.when(F.col("defects") <= accept, "accept").otherwise("reject"))
    return out.unionByName(total).select("class", "checked", "defects", F.round(F.try_divide(F.col("defects"), F.col("checked")), 6).alias("rate"), verdict.alias("verdict"))


def recorded_edges(files: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is recorded of sampled files, for a reviewer to find what is missing: repo, file, connection_id, to_id,
    target_name, symbol; one row per edge, so that a file with many is no large value. ``files``: repo, file."""
    mine = edges.select("repo", "file", "connection_id", "to_id", "symbol").join(files.select("repo", "file").distinct(), ["repo", "file"], "left_semi")
    return mine.join(nodes.select(F.col("component_id").alias("to_id"), F.col("name").alias("target_name")), "to_id", "left").select("repo", "file", "connection_id", "to_id", "target_name", "symbol")
