"""Structural rules over the graph; every rule gives rows of one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .graph_views import clean_path, ends
from .traverse import cyclic_sets, transitively_dead

#: Inferred tiers of folder names.
TIERS = {
    4: ("ui", "web", "frontend", "pages", "routes", "app", "api", "mcp"),
    3: ("cdp", "native", "media", "service", "services", "controllers", "handlers"),
    2: ("domain", "model", "models", "state", "store", "features"),
    1: ("core", "shared", "common", "base", "types", "utils", "lib"),
}
RULE_LIMIT = 20  # top lists of the ranked rules
DEGENERATE_SHARE, DEGENERATE_POPULATION = 0.5, 20


def _rows(df: DataFrame, rule: str, severity: str, component, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), component.alias("component_id"), detail.cast("string").alias("detail"))


def internal_modules(nodes: DataFrame) -> DataFrame:
    """Code modules of the estate itself: type component with a file that is no manifest."""
    return nodes.where("component_type = 'component' and file <> '' and not endswith(file, 'package.json')")


def import_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Import edges whose both ends are known: from_id, to_id."""
    known = nodes.select("component_id")
    e = edges.where("connection_type = 'imports'").select("from_id", "to_id")
    return e.join(known, e["from_id"] == known["component_id"], "left_semi").join(known, F.col("to_id") == known["component_id"], "left_semi")


def fan_counts(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """Edges (not neighbours) per internal module at one end: component_id, n."""
    e = import_edges(edges, nodes)
    return e.groupBy(F.col(end).alias("component_id")).agg(F.count(F.lit(1)).alias("n")).join(internal_modules(nodes).select("component_id", "name"), "component_id")


def module_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct internal neighbours without self, and shallowness out / (in + 1): component_id, fan_in, fan_out, shallowness."""
    mine = internal_modules(nodes).select("component_id", "name")
    e = import_edges(edges, mine).where("from_id <> to_id").distinct()
    i = e.groupBy(F.col("to_id").alias("component_id")).agg(F.count(F.lit(1)).alias("fan_in"))
    o = e.groupBy(F.col("from_id").alias("component_id")).agg(F.count(F.lit(1)).alias("fan_out"))
    zero = F.lit(0).cast("long")
    both = mine.join(i, "component_id", "left").join(o, "component_id", "left").select("component_id", "name", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))
    return both.withColumn("shallowness", F.round(F.col("fan_out") / (F.col("fan_in") + 1), 6))


def tier_of(file):
    """Tier of a path by its first folder, or the second below src, app and lib; null if the name is none of them."""
    parts = F.filter(F.split(F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), r"\.[^.]+$", ""), "/"), lambda x: x != "")
    head, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    key = F.lower(F.when(head.isin("src", "app", "lib"), F.coalesce(second, head)).otherwise(head))
    out = F.lit(None).cast("int")
    for tier, names in TIERS.items():
        out = F.when(key.isin(*names), tier).otherwise(out)
    return out


def layer_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Import edges between internal modules from a higher to a lower inferred tier (the reference's tested direction)."""
    mine = internal_modules(nodes).select("component_id", tier_of(F.col("file")).alias("tier")).where("tier is not null")
    e = edges.where("connection_type = 'imports'").select("connection_id", "from_id", "to_id")
    a, b = mine.select(F.col("component_id").alias("from_id"), F.col("tier").alias("from_tier")), mine.select(F.col("component_id").alias("to_id"), F.col("tier").alias("to_tier"))
    return e.join(a, "from_id").join(b, "to_id").where("from_tier > to_tier")


def _top(df: DataFrame, least: int) -> DataFrame:
    return df.orderBy(F.desc("n"), "component_id").limit(RULE_LIMIT).where(F.col("n") >= least)


def builtin_rules(nodes: DataFrame, edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """All rules: rule_id, severity, component_id, detail.

    A cycle of imports is one row, of the smallest id of its strongly connected set, with the set's size. ``nodes`` and
    ``edges`` are read many times: pass tables that are written (``session.cut``), not views that deduplicate.
    """
    of_layer = lambda layer, c: nodes.where(F.col("layer") == layer).select(F.col("component_id").alias(c))
    imports = edges.where("connection_type = 'imports'").select("connection_id", "from_id", "to_id", "connection_type")
    imports = cut(imports.join(nodes.select(F.col("component_id").alias("from_id")), "from_id", "left_semi").join(nodes.select(F.col("component_id").alias("to_id")), "to_id", "left_semi"))
    cycles = cyclic_sets(imports).groupBy(F.col("cycle").alias("component_id")).agg(F.count(F.lit(1)).alias("n"))
    used = edges.select(F.explode(F.array("from_id", "to_id")).alias("component_id")).where("component_id is not null").distinct()
    fed = edges.select("from_id", F.col("to_id").alias("component_id")).join(of_layer("backend", "from_id"), "from_id", "left_semi").select("component_id").distinct()
    direct = edges.select("connection_id", "from_id", "to_id").join(of_layer("database", "to_id"), "to_id", "left_semi").join(of_layer("frontend", "from_id"), "from_id", "left_semi")
    incoming = edges.where("to_id is not null").groupBy(F.col("to_id").alias("component_id")).agg(F.count(F.lit(1)).alias("n"))
    nid = F.col("component_id")
    status = lambda s, rule, sev: _rows(nodes.where(F.col("status") == s), rule, sev, nid, F.lit(s))
    hot, wide = _top(fan_counts(nodes, imports, "to_id"), 5), _top(fan_counts(nodes, imports, "from_id"), 8)
    depth = module_depth(nodes, imports).where("fan_out >= 4 and shallowness >= 2").orderBy(F.desc("shallowness"), F.desc("fan_out"), "component_id").limit(RULE_LIMIT)
    parts = [
        _rows(nodes.join(used, "component_id", "left_anti"), "orphan-component", "warning", nid, F.col("component_type")),
        _rows(nodes.where("layer = 'database'").join(fed, "component_id", "left_anti"), "database-no-backend", "warning", nid, F.lit("database")),
        _rows(direct, "frontend-direct-db", "error", F.col("from_id"), F.col("connection_id")),
        status("unused", "unused-package", "info"),
        status("vulnerable", "vulnerable-dependency", "error"),
        status("deprecated", "deprecated-dependency", "warning"),
        _rows(nodes.where("layer = 'backend'").join(incoming.where("n > 5"), "component_id"), "single-point-of-failure", "warning", nid, F.col("n")),
        _rows(hot, "hotspot-module", "warning", nid, F.col("n")),
        _rows(wide, "high-fan-out", "warning", nid, F.col("n")),
        _rows(depth, "shallow-module", "warning", nid, F.col("fan_out")),
        _rows(layer_violations(nodes, imports), "layer-violation", "error", F.col("from_id"), F.concat_ws(">", "from_tier", "to_tier")),
        _rows(duplicate_creation(nodes, edges), "duplicate-resource-creation", "warning", nid, F.col("sites")),
        _rows(cycles, "circular-dependency", "error", nid, F.col("n")),
        _rows(transitively_dead(nodes, edges, declared), "transitively-dead", "warning", nid, F.col("component_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_creation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Services and models that more than one edge instantiates without a singleton: component_id, sites."""
    services = nodes.where("component_type in ('service', 'llm')").select("component_id", "name")
    code = F.coalesce("code", F.lit(""))
    made = F.contains(code, F.concat("name", F.lit("("))) | F.contains(code, F.concat(F.lit("= "), F.col("name")))
    single = code.rlike(r"static\s+(let|var)|lazy\s+var|\.shared")
    hits = edges.select("to_id", "code").join(services, F.col("to_id") == F.col("component_id")).where(made & ~single)
    return hits.groupBy("component_id").agg(F.count(F.lit(1)).alias("sites")).where("sites > 1")


def forbidden_edges(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges that a custom rule forbids: rule_id, connection_id.

    ``rules``: id, from_layer, from_type, from_name, to_layer, to_type, to_name; null means any, names by substring.
    The rules are a stated set: they are read in blocks of 100 into one filter over the edges.
    """
    named = ends(edges, nodes).where("from_name is not null and to_name is not null")
    listed = [r.asDict() for r in rules.orderBy("id").toLocalIterator()]
    out = None
    for i in range(0, max(1, len(listed)), 100):
        tests = []
        for r in listed[i : i + 100]:
            cond = F.lit(True)
            for side in ("from", "to"):
                if r[f"{side}_layer"] is not None:
                    cond &= F.coalesce(F.col(f"{side}_layer") == r[f"{side}_layer"], F.lit(False))
                if r[f"{side}_type"] is not None:
                    cond &= F.coalesce(F.col(f"{side}_component_type") == r[f"{side}_type"], F.lit(False))
                if r[f"{side}_name"] is not None:
                    cond &= F.contains(F.lower(f"{side}_name"), F.lit(r[f"{side}_name"].lower()))
            tests.append(F.when(cond, F.lit(r["id"])))
        hits = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
        part = named.select(F.explode(hits).alias("rule_id"), "connection_id")
        out = part if out is None else out.unionByName(part)
    return out


def rule_counts(violations: DataFrame) -> DataFrame:
    """Distinct components per rule."""
    return violations.groupBy("rule_id", "severity").agg(F.countDistinct("component_id").alias("components"), F.count(F.lit(1)).alias("violations"))


def degenerate_rules(violations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rules that flag more than half of at least 20 components: rule_id, components, share_of_components, share_of_violations."""
    counts = rule_counts(violations).groupBy("rule_id").agg(F.sum("components").alias("components"))
    total = Window.partitionBy(F.lit(1))  # one row per rule
    population = nodes.count()
    shared = counts.select("rule_id", "components", F.round(F.col("components") / F.lit(max(1, population)), 6).alias("share_of_components"), F.round(F.col("components") / F.sum("components").over(total), 6).alias("share_of_violations"))
    return shared.where((F.col("share_of_components") > DEGENERATE_SHARE) & F.lit(population >= DEGENERATE_POPULATION))


#: Path patterns of edge classes, in their order.
CLASS_PATHS = (
    ("test", r"(__tests__|\.test\.|\.spec\.|/tests?/|/testing/)"),
    ("migration", r"(/migrations?/|/migrate|\.migration\.|/seeds?/)"),
    ("dev-only", r"(^scripts/|/scripts/|/dev/|\.dev\.|webpack\.config|vite\.config|rollup\.config|jest\.config|eslint|prettier|\.storybook)"),
    ("admin", r"(/admin/|/dashboard/|/internal/|/backoffice/)"),
    ("analytics", r"(/analytics/|/tracking/|/telemetry/|/metrics/|/monitoring/)"),
)
#: Names that hint at a class when no path does.
CLASS_NAMES = (("test", ("test",)), ("admin", ("admin",)), ("analytics", ("analytics", "metric")))


def classify_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Class of every edge by its own path, then its source's file, path before pattern; names next; else production.

    An edge with an unknown end is judged by its path only (test, dev-only, migration; 0.8). connection_id, class, class_confidence.
    """
    named = ends(edges, nodes, columns=("name", "file"))
    own, source = F.lower(F.coalesce("file", F.lit(""))), F.lower(F.coalesce("from_file", F.lit("")))
    known = F.col("from_name").isNotNull() & F.col("to_name").isNotNull()
    result = lambda c, p: F.struct(F.lit(c).alias("class"), F.lit(p).alias("class_confidence"))
    chain, loose = None, None
    for path in (own, source):
        for name, pattern in CLASS_PATHS:
            chain = F.when(path.rlike(pattern), result(name, 0.9)) if chain is None else chain.when(path.rlike(pattern), result(name, 0.9))
    for name, words in CLASS_NAMES:
        for side in ("from_name", "to_name"):
            for w in words:
                chain = chain.when(F.contains(F.lower(side), F.lit(w)), result(name, 0.7))
    for name in ("test", "dev-only", "migration"):
        pattern = dict(CLASS_PATHS)[name]
        loose = F.when(own.rlike(pattern), result(name, 0.8)) if loose is None else loose.when(own.rlike(pattern), result(name, 0.8))
    verdict = F.when(known, chain.otherwise(result("production", 0.4))).otherwise(loose.otherwise(result("production", 0.4)))
    return named.select("connection_id", verdict.alias("v")).select("connection_id", "v.class", "v.class_confidence")
