"""Listing, indexing, finding and counting of components, connections and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph_views import clean_path, trimmed

#: Base name rules of aliases.
BASE_NAME_RULES = ((r"\s*config([^A-Za-z0-9_].*)?$", ""), (r"\s*\(.*\)$", ""), (r"[@/].*", ""))
#: Path segments of third-party code.
VENDOR_SEGMENTS = ("node_modules", "bower_components", "vendor", "third_party", "thirdparty", "__generated__", ".next", ".nuxt", ".venv", "site-packages", "Pods", "Carthage")
#: Folders that hold copies of packages by their names.
PACKAGE_FOLDERS = ("packages", "deps", "externals", "vendor", "node_modules", "third_party")
#: Extensions of source files and folders that are not scanned.
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "rs", "swift", "css")
IGNORED_FOLDERS = ("node_modules", "dist", "build", "coverage", "__generated__")
#: Types whose unconnected components count as dead.
DEAD_TYPES = ("npm", "spm", "queue", "service", "llm", "infra", "database", "framework", "cron", "config")


def counts_by(nodes: DataFrame) -> DataFrame:
    """Counts per type, layer and status in one pass: dimension, value, components."""
    dims = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("component_type", "layer", "status")])
    return nodes.select(F.explode(dims).alias("d")).groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("components"))


def base_name(name: Column) -> Column:
    out = F.lower(name)
    for pattern, by in BASE_NAME_RULES:
        out = F.regexp_replace(out, pattern, by)
    return trimmed(out)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component_id with incoming and outgoing edge counts (parallel edges count, self-loops on both sides)."""
    both = F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counted = edges.select(F.explode(both).alias("e")).where("e.id is not null").groupBy("e.id").agg(F.sum("e.i").alias("incoming"), F.sum("e.o").alias("outgoing"))
    zero = F.lit(0).cast("long")
    return nodes.join(counted, nodes["component_id"] == counted["id"], "left").select("component_id", "name", "component_type", "layer", "seq", F.coalesce("incoming", zero).alias("incoming"), F.coalesce("outgoing", zero).alias("outgoing"))


def merge_aliases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One component per base name and type: the most connected, the first on ties; members counts what it stands for."""
    d = degrees(nodes, edges).withColumn("base", base_name(F.col("name")))
    best = F.max_by("component_id", F.struct((F.col("incoming") + F.col("outgoing")).alias("n"), (-F.col("seq")).alias("s")))
    return d.groupBy("base", "component_type").agg(best.alias("component_id"), F.count(F.lit(1)).alias("members"))


def file_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path -> component_id, the last claim wins; claims come from components, then from edges whose source is known."""
    own = nodes.where("file is not null").select(clean_path(F.col("file")).alias("path"), "component_id", F.lit(0).alias("rank"), "seq")
    known = nodes.select("component_id")
    used = edges.where("file is not null").join(known, edges["from_id"] == known["component_id"]).select(clean_path(F.col("file")).alias("path"), "component_id", F.lit(1).alias("rank"), edges["seq"])
    return own.unionByName(used).groupBy("path").agg(F.max_by("component_id", F.struct("rank", "seq")).alias("component_id"), F.count(F.lit(1)).alias("claims"))


def reverse_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """target file -> importing file, each pair once, without self references."""
    owned = nodes.where("file is not null").select("component_id", clean_path(F.col("file")).alias("path"))
    imports = edges.where("connection_type = 'imports' and file is not null")
    direct = imports.where(F.startswith("to_id", F.lit("FILE:"))).select(clean_path(F.expr("substr(to_id, 6)")).alias("target"), clean_path(F.col("file")).alias("importer"))
    through = imports.join(owned, F.col("to_id") == F.col("component_id")).select(F.col("path").alias("target"), clean_path(F.col("file")).alias("importer"))
    return direct.unionByName(through).where("target <> importer").distinct()


def file_connections(edges: DataFrame) -> DataFrame:
    """Per file: imports, imported_by, other_from, other_to. An edge belongs to its own file as a source and to the
    FILE: ids at its ends; for one file and role it counts once."""
    is_import = F.col("connection_type") == "imports"
    from_file = F.when(F.startswith("from_id", F.lit("FILE:")), F.expr("substr(from_id, 6)"))
    to_file = F.when(F.startswith("to_id", F.lit("FILE:")), F.expr("substr(to_id, 6)"))
    roles = F.array_distinct(F.array(F.struct(F.col("file").alias("path"), F.lit(True).alias("source")), F.struct(from_file.alias("path"), F.lit(True).alias("source")), F.struct(to_file.alias("path"), F.lit(False).alias("source"))))
    rows = edges.select(is_import.alias("i"), F.explode(roles).alias("r")).where("r.path is not null").select("i", "r.path", "r.source")
    n = lambda i, s: F.count_if((F.col("i") == i) & (F.col("source") == s))
    return rows.groupBy("path").agg(n(True, True).alias("imports"), n(True, False).alias("imported_by"), n(False, True).alias("other_from"), n(False, False).alias("other_to"))


def discover_files(source_files: DataFrame) -> DataFrame:
    """Distinct source paths per repo by extension, outside ignored folders."""
    path = clean_path(F.col("file"))
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    folders = F.split(path, "/")
    return source_files.where(F.col("file").isNotNull()).select("repo", path.alias("path"), ext.alias("extension"), folders.alias("f")).where(F.col("extension").isin(*SOURCE_EXTENSIONS) & ~F.arrays_overlap("f", F.array(*map(F.lit, IGNORED_FOLDERS)))).select("repo", "path", "extension").distinct()


def vendor_paths(source_files: DataFrame) -> DataFrame:
    """Distinct paths that pass through a vendor folder, with the folder that tells."""
    path = clean_path(F.col("file"))
    hit = F.filter(F.split(path, "/"), lambda x: x.isin(*VENDOR_SEGMENTS))
    return source_files.where("file is not null").select("repo", path.alias("path"), F.get(hit, F.lit(0)).alias("segment")).where("segment is not null").distinct()


def find_components(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Fuzzy search with the reference's scores; top ``limit`` by score, then id."""
    q = query.strip().lower()
    if not q:
        return nodes.limit(0).select("component_id", "name", F.lit(0).alias("score"))
    name, purpose, file = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "purpose", "file"))
    words = F.split(name, r"[\s/_.\-]+")
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    score = F.when(name == q, 100).when(F.contains(name, F.lit(q)), 60 + min(20, len(q))).otherwise(0)
    for t in q.split():
        score = score + F.when(F.array_contains(words, t), 30).otherwise(0) + F.when(F.array_contains(tags, t), 10).otherwise(0)
    score = score + F.when(F.contains(purpose, F.lit(q)), 20).otherwise(0) + F.when(F.contains(file, F.lit(q)), 8).otherwise(0)
    in_order = ".*".join("\\" + c if not c.isalnum() else c for c in q)
    final = F.when((score == 0) & name.rlike(in_order), 4).otherwise(score)
    return nodes.select("component_id", "name", final.alias("score")).where("score > 0").orderBy(F.desc("score"), "component_id").limit(limit)


def candidates(nodes: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Suggestions for a name that was not found: substring +3, common prefix, half a point off per letter of difference."""
    q = query.lower()
    name = F.lower("name")
    prefix = F.lit(0)
    for i in range(1, len(q) + 1):
        prefix = F.when(F.startswith(name, F.lit(q[:i])), i).otherwise(prefix)
    contains = F.when(F.contains(name, F.lit(q)) | F.contains(F.lit(q), name), 3).otherwise(0)
    score = (contains + prefix - F.abs(F.length(name) - len(q)) * F.lit(0.5)).cast("double")
    return nodes.select("component_id", "name", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "component_id").limit(limit)


def resolve(nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """One component for each row of ``queries`` (column query): exact id, exact name, exact path, then part of a name
    (most connected first, then shortest), base name, part of a path; the first seq breaks ties. step tells which.

    Exact steps are equi-joins. The substring steps run only for queries that are still open; those are a stated
    query set, collected in blocks of 100 and turned into one filter per block over all components.
    """
    d = degrees(nodes, edges).join(nodes.select("component_id", F.col("file").alias("file")), "component_id")
    d = d.withColumn("n", F.col("incoming") + F.col("outgoing")).withColumn("lname", F.lower("name")).withColumn("path", F.lower(clean_path(F.col("file"))))
    q = queries.where("query <> ''").select("query").distinct().withColumn("lq", F.lower("query")).withColumn("pq", F.lower(clean_path(F.col("query"))))
    pick = lambda df: df.groupBy("query").agg(F.min_by("component_id", F.struct("step", (-F.col("n")).alias("n"), F.length("name").alias("l"), "seq")).alias("component_id"), F.min("step").alias("step"))
    cols = ["query", "component_id", "name", "seq", "n"]
    exact = (
        q.join(d, F.col("query") == F.col("component_id")).select(*cols, F.lit(1).alias("step"))
        .unionByName(q.join(d, F.col("lq") == F.col("lname")).select("query", "component_id", "name", "seq", F.lit(0).cast("long").alias("n"), F.lit(2).alias("step")).withColumn("name", F.lit("")))
        .unionByName(q.join(d, F.col("pq") == F.col("path")).select("query", "component_id", "name", "seq", F.lit(0).cast("long").alias("n"), F.lit(3).alias("step")).withColumn("name", F.lit("")))
    )
    first = pick(exact)
    open_q = [r["query"] for r in q.join(first, "query", "left_anti").select("query").orderBy("query").toLocalIterator()]
    out = first
    for i in range(0, len(open_q), 100):
        hits = None
        tests = F.array(*[F.struct(F.lit(x).alias("query"), F.lit(x.lower()).alias("lq")) for x in open_q[i : i + 100]])
        hits = d.withColumn("t", F.explode(F.filter(tests, lambda t: F.contains(F.col("lname"), t["lq"]) | F.contains(F.coalesce(F.col("path"), F.lit("")), t["lq"]) | (base_name(F.col("name")) == base_name(t["query"])))))
        step = F.when(F.contains("lname", F.col("t.lq")), 4).when(base_name(F.col("name")) == base_name(F.col("t.query")), 5).otherwise(6)
        found = hits.select(F.col("t.query").alias("query"), "component_id", "name", "seq", "n", step.alias("step"))
        found = found.withColumn("n", F.when(F.col("step") < 6, F.col("n")).otherwise(0)).withColumn("name", F.when(F.col("step") == 4, F.col("name")).otherwise(""))
        out = out.unionByName(pick(found))
    return out


def bounded(df: DataFrame, limit: int, *order) -> DataFrame:
    """What a bounded listing reports of itself: total, returned, truncated, limit."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.least(total, F.lit(limit).cast("long")).alias("returned"), (total > limit).alias("truncated"), F.lit(limit).alias("limit"))


def search_lessons(lessons: DataFrame, pattern: str, category: str | None = None, severity: str | None = None) -> DataFrame:
    """Lessons whose pattern, resolution or any signature entry matches a regular expression without regard to case."""
    p = f"(?i){pattern}"
    hit = F.coalesce(F.col("pattern").rlike(p), F.lit(False)) | F.coalesce(F.col("resolution").rlike(p), F.lit(False)) | F.coalesce(F.exists("signature", lambda s: s.rlike(p)), F.lit(False))
    out = lessons.where(hit)
    if category is not None:
        out = out.where(F.lower("category") == category.lower())
    if severity is not None:
        out = out.where(F.lower("severity") == severity.lower())
    return out.select("seq", "lesson_id", "project", "category", "severity", "promoted")


def recurring_lessons(lessons: DataFrame, projects: int = 3) -> DataFrame:
    """Patterns that occur in at least ``projects`` distinct projects: pattern, category, projects, lessons."""
    return lessons.where("pattern is not null").groupBy(F.lower(trimmed(F.col("pattern"))).alias("pattern"), "category").agg(F.countDistinct("project").alias("projects"), F.count(F.lit(1)).alias("lessons")).where(F.col("projects") >= projects)


def repo_listing(nodes: DataFrame, edges: DataFrame, as_of: str, stale_hours: int = 24) -> DataFrame:
    """Per repo: components, connections, last detection, its age in whole hours at ``as_of``, stale."""
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("components"))
    e = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("connections"), F.max("detected_at").alias("last_detected"))
    age = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_detected").cast("timestamp"))) / 3_600_000_000)
    joined = n.join(e, "repo", "left").withColumn("age_hours", age)
    return joined.select("repo", "components", F.coalesce("connections", F.lit(0).cast("long")).alias("connections"), "last_detected", "age_hours", F.coalesce(F.col("age_hours") >= stale_hours, F.lit(False)).alias("stale"))


def coverage_bands(edges: DataFrame) -> DataFrame:
    """Connections per confidence band and class (a null class is unclassified; a null confidence is low)."""
    band = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    return edges.groupBy(band.alias("band"), F.coalesce("classification", F.lit("unclassified")).alias("classification")).agg(F.count(F.lit(1)).alias("connections"))


def coverage_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Gaps: zero-consumers, no-outgoing, low-confidence-connection; gap and target."""
    d = degrees(nodes, edges)
    none = F.coalesce("layer", F.lit(""))
    zero = d.where((F.col("incoming") == 0) & (none != "external")).select(F.lit("zero-consumers").alias("gap"), F.col("component_id").alias("target"))
    dead = d.where((F.col("outgoing") == 0) & ~none.isin("database", "external")).select(F.lit("no-outgoing").alias("gap"), F.col("component_id").alias("target"))
    low = edges.where("confidence < 0.5").select(F.lit("low-confidence-connection").alias("gap"), F.col("connection_id").alias("target"))
    return zero.unionByName(dead).unionByName(low)


def coverage_summary(nodes: DataFrame, edges: DataFrame, source_files: DataFrame) -> DataFrame:
    """Source files, mapped ones, percent, mean confidence and overall confidence, in one row."""
    files = source_files.where("file is not null").select("repo", clean_path(F.col("file")).alias("path")).distinct()
    own = nodes.where("file is not null").select("repo", clean_path(F.col("file")).alias("path"))
    used = edges.where("file is not null").select("repo", clean_path(F.col("file")).alias("path"))
    mapped = files.join(own.unionByName(used).distinct(), ["repo", "path"], "left_semi").agg(F.count(F.lit(1)).alias("mapped"))
    total = files.agg(F.count(F.lit(1)).alias("total"))
    mean = edges.agg(F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("mean_confidence"), F.count(F.lit(1)).alias("connections"))
    one = F.lit(1).alias("k")  # three rows of one row each
    row = total.withColumn("k", one).join(mapped.withColumn("k", one), "k").join(mean.withColumn("k", one), "k")
    percent = F.when(F.col("total") > 0, F.round(F.col("mapped") * 100 / F.col("total"))).otherwise(0).cast("long")
    overall = F.when(F.col("connections") > 0, F.round(F.col("mean_confidence") * 0.6 + F.col("percent") / 100 * 0.4, 2)).otherwise(0.0)
    return row.withColumn("percent", percent).select("total", "mapped", "percent", "connections", "mean_confidence", overall.alias("overall_confidence"))


def dead_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active components of the listed types that no connection touches."""
    used = edges.select(F.explode(F.array("from_id", "to_id")).alias("component_id")).where("component_id is not null").distinct()
    return nodes.where(F.col("component_type").isin(*DEAD_TYPES) & (F.col("status") == "active")).join(used, "component_id", "left_anti").select("component_id", "name", "component_type")


def top_per_layer(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most connected components of each layer (critical first, then degree, then id), with their rank."""
    d = degrees(nodes, edges).join(nodes.select("component_id", "critical"), "component_id")
    w = Window.partitionBy("layer").orderBy(F.desc(F.coalesce("critical", F.lit(False))), F.desc(F.col("incoming") + F.col("outgoing")), "component_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("layer", "rank", "component_id", (F.col("incoming") + F.col("outgoing")).alias("degree"))
