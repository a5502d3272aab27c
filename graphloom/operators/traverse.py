"""Bounded traversals and graph metrics as loops of joins; every loop cuts its lineage with a reliable checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut, drop_cut
from .catalog import PACKAGE_FOLDERS, VENDOR_SEGMENTS
from .graph_views import clean_path

#: Weights of edge types in a route's score.
ROUTE_WEIGHTS = {"queue-produces": 3, "queue-consumes": 3, "queue-uses-cache": 3, "deploys-to": 3, "runtime-binding": 3, "cron-triggers": 2, "api-calls-db": 2, "schema-relation": 2, "service-call": 1, "field-reference": 1}
NOT_TRACED = ("env-dependency",)
MIN_METRIC_NODES = 20


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct pairs of ends without nulls: parallel edges collapse before any traversal."""
    return edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).where("src is not null and dst is not null").distinct()


def severity(layer, critical, dependents):
    return (
        F.when(layer.isin("database", "infra") | (dependents > 5) | F.coalesce(critical, F.lit(False)), "critical")
        .when((layer == "backend") | dependents.between(3, 5), "high")
        .when(dependents == 2, "medium")
        .otherwise("low")
    )


def impact(nodes: DataFrame, edges: DataFrame, component_id: str) -> DataFrame:
    """Direct and one-hop dependents of a component: affected_id, via_id (null if direct), connection_id, impact_type.

    Parallel edges and repeated routes are kept, as each is a place to change. Dependents must be known components.
    """
    known = nodes.select(F.col("component_id").alias("affected_id"))
    into = edges.select("connection_id", F.col("from_id").alias("affected_id"), F.col("to_id").alias("target"))
    direct = into.where(F.col("target") == component_id).join(known, "affected_id", "left_semi")
    first = cut(direct.select("affected_id").distinct())
    two = into.where(F.coalesce(F.col("affected_id") != component_id, F.lit(False))).join(first.withColumnRenamed("affected_id", "target"), "target", "left_semi").join(first, "affected_id", "left_anti").join(known, "affected_id", "left_semi")
    cols = lambda df, via, kind: df.select("affected_id", via.alias("via_id"), "connection_id", F.lit(kind).alias("impact_type"))
    return cols(direct, F.lit(None).cast("string"), "direct").unionByName(cols(two, F.col("target"), "transitive"))


def impact_severity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Severity of a change in each component by its layer, mark and distinct known dependents."""
    known = nodes.select(F.col("component_id").alias("src"))
    n = simple_edges(edges).join(known, "src", "left_semi").groupBy(F.col("dst").alias("component_id")).agg(F.count(F.lit(1)).alias("dependents"))
    rows = nodes.select("component_id", "layer", "critical").join(n, "component_id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0).cast("long")))
    return rows.select("component_id", "dependents", severity(F.col("layer"), F.col("critical"), F.col("dependents")).alias("severity"))


def neighbourhood(edges: DataFrame, focus: DataFrame, depth: int = 2) -> DataFrame:
    """Undirected breadth-first distance from the ids of ``focus`` (column id): id, distance. Unknown ids may be visited."""
    pairs = simple_edges(edges)
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = cut(focus.select("id", F.lit(0).alias("distance")).distinct())
    frontier = seen
    for step in range(1, depth + 1):
        found = both.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(found.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


#: Graphs of at most this many distinct pairs are searched by one task (some 100 MB of names), larger ones in rounds.
PAIRS_OF_ONE_TASK = 1 << 19


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that are reached from the rows without src, by breadth."""
    after: dict[str, list[str]] = {}
    todo = []
    for b in batches:
        for x, y in zip(b.column("src").to_pylist(), b.column("dst").to_pylist()):
            todo.append(y) if x is None else after.setdefault(x, []).append(y)
    seen = set(todo)
    while todo:
        todo = list({y for x in todo for y in after.get(x, ())} - seen)
        seen.update(todo)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["id"])


def reachable(edges: DataFrame, entries: DataFrame, source: str = "from_id", target: str = "to_id") -> DataFrame:
    """Ids that can be reached from ``entries`` (column id) along edges, entries included.

    A graph of up to ``PAIRS_OF_ONE_TASK`` pairs and entries, which are counted, is searched by one task. A larger one is
    searched in rounds, those of the longest way, until a frontier is empty; every fifth round joins what was seen in one
    table and frees the tables before. The result is the same.
    """
    pairs = cut(edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).where("src is not null and dst is not null").distinct())
    seen = cut(entries.select("id").where("id is not null").distinct())
    if pairs.count() + seen.count() <= PAIRS_OF_ONE_TASK:
        both = pairs.unionByName(seen.select(F.lit(None).cast("string").alias("src"), F.col("id").alias("dst")))
        return cut(both.coalesce(1).mapInArrow(_reach, "id string"))
    frontier, parts = seen, [seen]
    while True:
        found = pairs.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(found.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            drop_cut(pairs)
            return seen
        parts.append(frontier)
        seen = seen.unionByName(frontier)
        if len(parts) > 5:
            seen, frontier = cut(seen), parts[-1]
            for p in parts[:-1]:
                drop_cut(p)
            parts = [frontier, seen]


#: Types, names and tags of components where execution starts.
ENTRY_TYPES = ("api-endpoint", "worker", "cron", "xcode-target")
ENTRY_NAMES = r"(?i)App$|AppDelegate|@main|ContentView|SceneDelegate|(?:^|[/\\.:#\s_-])Main(?:$|[/\\.:#\s_-])"
ENTRY_TAGS = ("entrypoint", "route", "navigation-root")
#: Path conventions of roots that nothing imports, in order.
ENTRY_PATHS = (
    ("test-file", r"(^|/)__tests__/"),
    ("test-file", r"(^|/)tests?/"),
    ("test-file", r"\.(test|spec)\.[cm]?[jt]sx?$"),
    ("framework-route", r"^(?:[^/]+/)?(?:src/)?app/(?:.*/)?(?:page|layout|route|template|default|error|global-error|not-found|loading)\.[cm]?[jt]sx?$"),
    ("framework-route", r"^(?:[^/]+/)?(?:src/)?pages/.*\.[cm]?[jt]sx?$"),
    ("framework-route", r"^(?:[^/]+/)?(?:src/)?(?:middleware|instrumentation)\.[cm]?[jt]s$"),
    ("tooling-config", r"(^|/)[\w.-]*\.config\.[cm]?[jt]sx?$"),
    ("executable-dir", r"(^|/)(scripts|bin)/"),
)
ENTRY_LAYERS = ("infra", "external")
#: Types and files of declared dependencies and environment, which are never dead code.
PACKAGE_TYPES = ("npm", "pip", "spm", "cargo", "go", "gem", "composer")
NEVER_DEAD = (*PACKAGE_TYPES, "infra", "config", "document")
MANIFESTS = (
    "package.json", "package-lock.json", "requirements.txt", "pyproject.toml", "Pipfile", "Cargo.toml", "Cargo.lock", "Package.swift", "go.mod", "Gemfile", "composer.json", "pubspec.yaml", "build.gradle", "pom.xml",
)


def entry_points(nodes: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Components where execution starts, by the first reason that holds: id, reason.

    A manifest's declaration (``declared``: repo, path, source), the type, the name, a tag, a path convention, or the
    layer (infra and external are no code to keep alive). Path conventions are anchored, so that ordinary folders of
    these names deeper down are none.
    """
    path = clean_path(F.coalesce("file", F.lit("")))
    reason = F.when(F.col("component_type").isin(*ENTRY_TYPES), "component-type").when(F.col("name").rlike(ENTRY_NAMES), "name-pattern").when(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, ENTRY_TAGS))), F.lit(False)), "tag")
    for source, pattern in ENTRY_PATHS:
        reason = reason.when(path.rlike(pattern), source)
    reason = reason.when(F.col("layer").isin(*ENTRY_LAYERS), "infra-layer")
    if declared is None:
        return nodes.select(F.col("component_id").alias("id"), reason.alias("reason")).where("reason is not null")
    told = declared.groupBy("repo", F.col("path").alias("told_path")).agg(F.min("source").alias("told"))
    rows = nodes.select("component_id", "repo", path.alias("told_path"), reason.alias("reason")).join(told, ["repo", "told_path"], "left")
    return rows.select(F.col("component_id").alias("id"), F.coalesce("told", "reason").alias("reason")).where("reason is not null")


def _in_package_folder(nodes: DataFrame) -> DataFrame:
    """Components whose path has a folder of packages followed by the name of a known package: component_id."""
    names = nodes.where(F.col("component_type").isin(*PACKAGE_TYPES)).select(F.col("name").alias("folder")).distinct()
    parts = F.split(clean_path(F.col("file")), "/")
    inner = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.when(F.try_element_at(parts, i - 1).isin(*PACKAGE_FOLDERS), F.try_element_at(parts, i)))
    return nodes.where("file is not null").select("component_id", F.explode(F.array_compact(inner)).alias("folder")).join(names, "folder", "left_semi").select("component_id").distinct()


def unreached(nodes: DataFrame, edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Connected components that no entry point reaches, but dependencies and environment: component_id, component_type,
    suppressed (dependency-manifest or vendored if the file is not the authors' own, null for dead code).

    Without any entry point nothing can be told, and there are no rows. Unconnected components are orphans instead.
    """
    entries = entry_points(nodes, declared)
    rest = nodes.where(~F.col("component_type").isin(*NEVER_DEAD))
    if entries.isEmpty():
        return rest.limit(0).select("component_id", "component_type", F.lit(None).cast("string").alias("suppressed"))
    live = reachable(edges, entries.select("id"))
    linked = edges.select(F.explode(F.array("from_id", "to_id")).alias("component_id")).where("component_id is not null").distinct()
    rows = rest.join(live, rest["component_id"] == live["id"], "left_anti").join(linked, "component_id", "left_semi")
    copied = _in_package_folder(nodes).withColumn("copied", F.lit(True))
    path = clean_path(F.coalesce("file", F.lit("")))
    why = F.when(F.element_at(F.split(path, "/"), -1).isin(*MANIFESTS), "dependency-manifest").when(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_SEGMENTS))) | F.col("copied").isNotNull(), "vendored")
    return rows.join(copied, "component_id", "left").select("component_id", "component_type", why.alias("suppressed"))


def transitively_dead(nodes: DataFrame, edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Components of the authors' own code that are connected but reached from no entry point: component_id, component_type."""
    return unreached(nodes, edges, declared).where("suppressed is null").select("component_id", "component_type")


def reachability_report(nodes: DataFrame, edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """What the search for dead code saw: item, value (entry points by reason, components that were considered, and those
    of them that were suppressed by reason)."""
    entries = entry_points(nodes, declared).groupBy(F.concat(F.lit("entry:"), "reason").alias("item")).agg(F.count(F.lit(1)).alias("value"))
    rest = cut(unreached(nodes, edges, declared))
    kinds = rest.where("suppressed is not null").groupBy(F.concat(F.lit("suppressed:"), "suppressed").alias("item")).agg(F.count(F.lit(1)).alias("value"))
    return entries.unionByName(kinds).unionByName(rest.groupBy().agg(F.count(F.lit(1)).alias("value")).select(F.lit("considered").alias("item"), "value"))


#: What counts as production when paths are filtered by classification, beside edges without one.
PRODUCTION = ("", "production", "unknown", "admin", "analytics")


def trace(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 5, direction: str = "forward", classification: str | None = None) -> DataFrame:
    """All paths without repeated nodes from ``start``: route (ids joined by >), types, hops, score.

    ``direction`` is forward, backward or both. A queue is a bridge: entered by queue-produces it also leads to its
    consumers, by queue-consumes also to its producers. ``classification`` keeps the edges of one class; production is
    all that is not marked as something else. A path ends at ``depth``, or where no edge leads on to an unvisited known
    node. Edges are collapsed to (from, to, type) first, env-dependency edges are not followed; the score weighs edge
    types, new layers and length.
    The number of paths is exponential in depth by definition: bound the depth, or start where fan-out is small.
    """
    if direction not in ("forward", "backward", "both"):
        raise ValueError(f"direction is forward, backward or both, not {direction}")
    known = nodes.select(F.col("component_id").alias("dst"), F.coalesce("layer", F.lit("")).alias("dst_layer"))
    keep = F.lit(True) if classification is None else F.coalesce("classification", F.lit("")).isin(*PRODUCTION) if classification == "production" else F.coalesce(F.col("classification") == classification, F.lit(False))
    links = edges.where(~F.col("connection_type").isin(*NOT_TRACED)).withColumn("keep", keep).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "connection_type", "keep").dropna()
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "connection_type", "keep")
    plain = {"forward": links, "backward": back, "both": links.unionByName(back)}[direction]
    # via: the type of edge by which a bridge must be entered; null where none is asked for
    step = plain.withColumn("via", F.lit(None).cast("string"))
    if direction != "both":
        other, kind, via = (back, "queue-produces", "queue-consumes") if direction == "forward" else (links, "queue-consumes", "queue-produces")
        queues = nodes.where("component_type = 'queue'").select(F.col("component_id").alias("src"))
        step = step.unionByName(other.where(F.col("connection_type") == kind).join(queues, "src", "left_semi").join(plain.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("via", F.lit(via)))
    step = cut(step.where("keep").drop("keep").distinct().join(known, "dst"))
    first = nodes.where(F.col("component_id") == start)
    live = first.select(F.array("component_id").alias("ids"), F.array().cast("array<string>").alias("types"), F.array(F.coalesce("layer", F.lit(""))).alias("layers"))
    done = None
    for _ in range(depth):
        tip = live.withColumn("src", F.element_at("ids", -1))
        grown = tip.join(step, "src").where(~F.array_contains("ids", F.col("dst")) & (F.col("via").isNull() | F.coalesce(F.try_element_at("types", F.lit(-1)) == F.col("via"), F.lit(False))))
        grown = cut(grown.select(F.concat("ids", F.array("dst")).alias("ids"), F.concat("types", F.array("connection_type")).alias("types"), F.concat("layers", F.array("dst_layer")).alias("layers")))
        ended = live.join(grown.select(F.slice("ids", 1, F.size("ids") - 1).alias("ids"), F.slice("types", 1, F.size("types") - 1).alias("types")).distinct(), ["ids", "types"], "left_anti").where("size(ids) > 1")
        done = ended if done is None else done.unionByName(ended)
        live = grown
    done = done.unionByName(live) if done is not None else live
    weights = F.create_map(*[x for k, v in ROUTE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    weighed = F.aggregate("types", F.lit(0), lambda a, t: a + F.coalesce(F.try_element_at(weights, t), F.lit(0)))
    new_layers = F.greatest(F.size(F.array_distinct(F.filter("layers", lambda x: x != ""))) - 1, F.lit(0)) * 2
    score = weighed + new_layers + F.least(F.size("ids"), F.lit(6))
    return done.where("size(ids) > 1").select(F.array_join("ids", ">").alias("route"), F.array_join("types", ">").alias("types"), (F.size("ids") - 1).alias("hops"), score.alias("score"))


def short_cycles(edges: DataFrame, limit: int = 3) -> DataFrame:
    """Cycles of up to ``limit`` distinct nodes (2 or 3) once each, from their smallest id: cycle, length.

    Order-free where the reference reports the back edges of one depth-first search; this is a superset of short ones.
    Pairs are oriented from the smaller id, so each cycle is built once and a hub only meets its larger neighbours.
    """
    p = cut(simple_edges(edges).where("src <> dst"))
    back = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    two = p.where("src < dst").join(back, ["src", "dst"]).select(F.concat_ws(">", "src", "dst").alias("cycle"), F.lit(2).alias("length"))
    if limit < 3:
        return two
    a = p.where("src < dst").select(F.col("src").alias("x"), F.col("dst").alias("y"))
    closing = p.where("src > dst").select(F.col("src").alias("z"), F.col("dst").alias("x"))
    middle = p.select(F.col("src").alias("y"), F.col("dst").alias("z"))
    three = a.join(closing, "x").where("y <> z").join(middle, ["y", "z"]).select(F.concat_ws(">", "x", "y", "z").alias("cycle"), F.lit(3).alias("length"))
    return two.unionByName(three)


def _trimmed(pairs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``pairs`` (src, dst) without those that begin or end outside: trimmed until each end has pairs both in and out."""
    p, n, rounds = pairs, pairs.count(), 0
    while n:
        if rounds == max_rounds:
            raise RuntimeError(f"trimming has not ended after {max_rounds} rounds; {n} edges are left")
        rounds += 1
        before, p = p, cut(p.join(p.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(p.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        drop_cut(before)
        m = p.count()
        if m == n:
            break
        n = m
    return p


def in_cycle(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """What is left after trimming nodes without incoming or outgoing edges until none is: every cycle lies within (column id).

    Each round trims both ends of a chain by one node. A bound that is reached is an error, as the rest is no core yet.
    """
    p = _trimmed(cut(simple_edges(edges).where("src <> dst")), max_rounds)
    return p.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _spread_least(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each id's least label among all that reach it along ``pairs``: id, label. Only labels that changed go on."""
    fresh = labels
    while True:
        sent = pairs.join(fresh.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("got"))
        joined = labels.join(sent, "id", "left").select("id", F.least("label", "got").alias("label"), F.coalesce(F.col("got") < F.col("label"), F.lit(False)).alias("changed"))
        before, labels = labels, cut(joined)
        fresh = labels.where("changed").select("id", "label")
        done = fresh.isEmpty()
        labels = labels.select("id", "label") if done else labels
        if hasattr(before, "cut_path"):
            drop_cut(before)
        if done:
            return labels


def strong_sets(src: list[str], dst: list[str]) -> dict[str, str]:
    """Each node of a strongly connected set of at least two to the set's smallest id, by one depth-first search."""
    number: dict[str, int] = {}
    for x in (*src, *dst):
        number.setdefault(x, len(number))
    after: list[list[int]] = [[] for _ in number]
    for a, b in zip(src, dst):
        after[number[a]].append(number[b])
    names, order, low, stack, path, count = list(number), [-1] * len(number), [0] * len(number), [], [False] * len(number), 0
    out: dict[str, str] = {}
    for root in range(len(names)):
        if order[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, k = work.pop()
            if not k:
                order[v] = low[v] = count
                count += 1
                stack.append(v)
                path[v] = True
            else:
                low[v] = min(low[v], low[after[v][k - 1]])
            while k < len(after[v]):
                w = after[v][k]
                k += 1
                if order[w] < 0:
                    work += [(v, k), (w, 0)]
                    break
                if path[w]:
                    low[v] = min(low[v], order[w])
            else:
                if low[v] == order[v]:
                    members = []
                    while not members or members[-1] != v:
                        members.append(stack.pop())
                        path[members[-1]] = False
                    if len(members) > 1:
                        least = min(names[m] for m in members)
                        out |= {names[m]: least for m in members}
    return out


def cyclic_sets(edges: DataFrame) -> DataFrame:
    """Strongly connected sets of at least two nodes: id, cycle (the set's smallest id).

    By rounds of colours: trim what lies in no cycle, give each node the least id that reaches it, take for each id that
    kept its own colour what reaches it within that colour, and go on with the rest. Two nodes are in a set if each
    reaches the other, so the result does not depend on any order of search. A node's edge to itself is no cycle.
    A graph of up to ``PAIRS_OF_ONE_TASK`` pairs, which are counted, is searched by one task instead, with the same result.
    """
    pairs = cut(simple_edges(edges).where("src <> dst"))
    if pairs.count() <= PAIRS_OF_ONE_TASK:

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            src, dst = [], []
            for b in batches:
                src += b.column("src").to_pylist()
                dst += b.column("dst").to_pylist()
            sets = strong_sets(src, dst)
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.string()), pa.array(list(sets.values()), pa.string())], ["id", "cycle"])

        return cut(pairs.coalesce(1).mapInArrow(search, "id string, cycle string"))
    found = None
    while True:
        core = _trimmed(pairs)
        if core.isEmpty():
            return found if found is not None else core.select(F.col("src").alias("id"), F.col("src").alias("cycle"))
        own = core.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colour = cut(_spread_least(core, cut(own.select("id", F.col("id").alias("label")))))
        within = core.join(colour.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = cut(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        sets = cut(colour.join(reachable(back, colour.where("id = label").select("id"), "src", "dst"), "id", "left_semi"))
        sized = sets.join(sets.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "label").select("id", F.col("label").alias("cycle"))
        found = sized if found is None else found.unionByName(sized)
        gone = sets.select("id")
        pairs = cut(core.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """PageRank over distinct edges between known nodes, self-loops kept, mass of dangling nodes spread evenly.

    Rounds end when the ranks' summed change is below ``tolerance`` (at damping 0.85 within 100 rounds, as the change
    shrinks by the damping in each); tolerance 0 runs all ``rounds``. Below 20 nodes there is no result (metrics on tiny
    graphs say nothing). Contributions are summed with a map-side combine, so a hub receives one number per task.
    component_id, rank (rounded to 9 places).
    """
    ids = cut(nodes.select(F.col("component_id").alias("id")))
    n = ids.count()
    if n < MIN_METRIC_NODES:
        return ids.limit(0).select(F.col("id").alias("component_id"), F.lit(0.0).alias("rank"))
    p = simple_edges(edges).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = p.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = cut(p.join(out, "src").select("src", "dst", "degree"))
    ranks = cut(ids.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", "degree", F.lit(1.0 / n).alias("rank"), F.lit(1.0).alias("change")))
    for _ in range(rounds):
        now = ranks.agg(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))).alias("m"), F.sum("change").alias("change")).first()
        if now["change"] < tolerance:
            break
        given = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        base = (1 - damping) / n + damping * (now["m"] or 0.0) / n
        new = F.lit(base) + damping * F.coalesce("got", F.lit(0.0))
        before, ranks = ranks, cut(ranks.join(given, "id", "left").select("id", "degree", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
        drop_cut(before)
    return ranks.select(F.col("id").alias("component_id"), F.round("rank", 9).alias("rank"))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Deterministic label propagation: each node takes the commonest label among its neighbours (smallest on ties).

    A published alternative to a seeded modularity search whose source is not at hand. component_id, community.
    Rounds end when no label changes, or when all labels are those of two rounds before: voting at once on an undirected
    graph comes to one of the two. In the latter case each node takes the smaller of its two labels.
    Counting labels per (node, label) pre-aggregates a hub's neighbours before its own vote.
    """
    p = simple_edges(edges).where("src <> dst")
    both = p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    ids = nodes.select(F.col("component_id").alias("src"))
    both = cut(both.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi"))
    labels = cut(ids.select(F.col("src").alias("id"), F.col("src").alias("label"), F.lit(None).cast("string").alias("last"), F.lit(None).cast("string").alias("earlier")))
    while True:
        votes = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        won = votes.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("won"))
        before, labels = labels, cut(labels.join(won, "id", "left").select("id", F.coalesce("won", "label").alias("label"), F.col("label").alias("last"), F.col("last").alias("earlier")))
        drop_cut(before)
        differ = labels.agg(F.count_if(F.col("label") != F.col("last")).alias("last"), F.count_if(~F.col("label").eqNullSafe(F.col("earlier"))).alias("earlier")).first()
        if not differ["last"] or not differ["earlier"]:
            return labels.select(F.col("id").alias("component_id"), F.least("label", "last").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of given labels over distinct directed pairs: one row, q rounded to 6 places (null without edges)."""
    p = simple_edges(edges)
    l = lambda c: labels.select(F.col("component_id").alias(c), F.col("community").alias(f"{c}_c"))
    e = p.join(l("src"), "src").join(l("dst"), "dst")
    inside = e.groupBy().agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("src_c") == F.col("dst_c")).alias("same"))
    sums = e.select(F.explode(F.array(F.struct(F.col("src_c").alias("c"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_c").alias("c"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    prod = sums.groupBy("x.c").agg(F.sum("x.o").alias("o"), F.sum("x.i").alias("i")).agg(F.sum(F.col("o").cast("double") * F.col("i")).alias("prod"))
    both = inside.withColumn("k", F.lit(1)).join(prod.withColumn("k", F.lit(1)), "k")
    return both.select(F.round(F.try_divide(F.col("same").cast("double"), F.col("m")) - F.try_divide(F.col("prod"), F.col("m").cast("double") * F.col("m")), 6).alias("q"))


def bridge_ratio(nodes: DataFrame, edges: DataFrame, group: str = "layer", least: int = 2) -> DataFrame:
    """Share of a node's edges that leave its group, among edges between known nodes: component_id, edges, crossing, bridge."""
    g = nodes.select(F.col("component_id").alias("id"), F.coalesce(group, F.lit("")).alias("g"))
    e = edges.select("from_id", "to_id").join(g.select(F.col("id").alias("from_id"), F.col("g").alias("fg")), "from_id").join(g.select(F.col("id").alias("to_id"), F.col("g").alias("tg")), "to_id")
    cross = (F.col("fg") != F.col("tg")).cast("int")
    rows = e.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), cross.alias("x")), F.struct(F.col("to_id").alias("id"), cross.alias("x")))).alias("r"))
    got = rows.groupBy(F.col("r.id").alias("component_id")).agg(F.count(F.lit(1)).alias("edges"), F.sum("r.x").alias("crossing"))
    return got.select("component_id", "edges", "crossing", F.when(F.col("edges") >= least, F.round(F.col("crossing") / F.col("edges"), 6)).otherwise(0.0).alias("bridge"))


def common_prefix(paths: DataFrame, key: str, path: str) -> DataFrame:
    """Longest common folder prefix of the paths of each key: key, prefix.

    The common prefix of a set is that of its smallest and largest member, so two aggregates are enough.
    """
    ends_ = paths.where(F.col(path).isNotNull()).select(key, F.split(path, "/").alias("p")).groupBy(key).agg(F.min("p").alias("a"), F.max("p").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.coalesce(F.array_position(same, False) - 1, F.size("a").cast("long"))
    n = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.least(F.size("a"), F.size("b")).cast("long"))
    folders = F.least(n.cast("int"), F.size("a") - 1, F.size("b") - 1)
    return ends_.select(key, F.array_join(F.slice("a", 1, F.greatest(folders, F.lit(0))), "/").alias("prefix"))
