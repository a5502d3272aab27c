"""Small graphs built by hand with the rows that they must give."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.operators import audit, catalog, estate, extract, history, merge, rules, services, traverse
from graphloom.functions.ids import edge_id, fnv1a_base36, stable_id
from graphloom.sources import discover, jsonl

T = dt.datetime(2025, 1, 1)
NODE = "seq long, component_id string, stable_id string, repo string, name string, component_type string, layer string, version string, purpose string, critical boolean, status string, tags array<string>, file string, confidence double"
EDGE = "seq long, connection_id string, repo string, from_id string, to_id string, connection_type string, file string, symbol string, line int, code string, confidence double, classification string, detected_at timestamp"


def nodes(spark, *rows):
    """(id, type, layer, file) and more by name."""
    out = []
    for i, r in enumerate(rows, 1):
        cid, kind, layer, file, *more = [*r, None, None, None][: max(4, len(r))]
        extra = more[0] if more and isinstance(more[0], dict) else {}
        out.append((i, cid, extra.get("stable"), extra.get("repo", "r"), extra.get("name", cid), kind, layer, extra.get("version"), extra.get("purpose"), extra.get("critical", False), extra.get("status", "active"), extra.get("tags"), file, 0.9))
    return spark.createDataFrame(out, NODE)


def edges(spark, *rows):
    """(from, to, type, file, class, code)"""
    out = []
    for i, r in enumerate(rows, 1):
        a, b, kind, file, cls, code = [*r, None, None, None, None][:6]
        out.append((i, f"E{i}", "r", a, b, kind or "imports", file, None, i, code, 0.9, cls, T))
    return spark.createDataFrame(out, EDGE)


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def test_impact_keeps_repeated_routes_and_self_edges(spark):
    n = nodes(spark, *[(x, "component", "backend", None) for x in "abcd"])
    e = edges(spark, ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "a"), ("x", "a"), ("b", "c"))
    got = ids(traverse.impact(n, e, "a").select("affected_id", F.coalesce("via_id", F.lit("-")).alias("via_id"), "impact_type"), "affected_id", "via_id", "impact_type")
    assert got == [("a", "-", "direct"), ("b", "-", "direct"), ("c", "-", "direct"), ("d", "b", "transitive"), ("d", "c", "transitive")]


def test_severity_order(spark):
    n = nodes(spark, ("db", "database", "database", None), ("be", "service", "backend", None), ("fe", "component", "frontend", None), ("hot", "component", "frontend", None), ("star", "component", "frontend", None, {"critical": True}), *[(f"u{i}", "component", "frontend", None) for i in range(6)])
    e = edges(spark, ("u0", "fe"), ("u1", "fe"), ("u1", "fe"), *[(f"u{i}", "hot") for i in range(6)])
    got = dict(ids(traverse.impact_severity(n, e), "component_id", "severity"))
    assert (got["db"], got["be"], got["fe"], got["hot"], got["star"], got["u0"]) == ("critical", "high", "medium", "critical", "critical", "low")


def test_neighbourhood_and_reachability(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("x", "b"), ("d", "b"), ("y", "z"))
    focus = spark.createDataFrame([("a",)], "id string")
    assert ids(traverse.neighbourhood(e, focus, 2), "id", "distance") == [("a", 0), ("b", 1), ("c", 2), ("d", 2), ("x", 2)]
    assert ids(traverse.reachable(e, focus), "id") == ["a", "b", "c", "d"]
    chain = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(14)])
    assert len(ids(traverse.reachable(chain, spark.createDataFrame([("n0",)], "id string")), "id")) == 15


def test_trace_paths(spark):
    n = nodes(spark, ("a", "component", "frontend", None), ("b", "service", "backend", None), ("c", "database", "database", None), ("e", "config", None, None))
    e = edges(spark, ("a", "b", "service-call"), ("a", "b", "service-call"), ("b", "c", "api-calls-db"), ("b", "a", "imports"), ("a", "e", "env-dependency"), ("b", "nowhere", "imports"))
    got = traverse.trace(n, e, "a", 3).collect()
    assert [(r["route"], r["types"], r["hops"], r["score"]) for r in got] == [("a>b>c", "service-call>api-calls-db", 2, 3 + 4 + 3)]


def test_trace_has_directions_bridges_classes_and_five_hops(spark):
    """A chain, a queue with two producers and a consumer, beside a search by hand."""
    n = nodes(spark, *[(f"c{i}", "component", None, None) for i in range(8)], ("q", "queue", None, None), *[(x, "component", None, None) for x in ("p1", "p2", "w", "x")])
    rows = [*[(f"c{i}", f"c{i + 1}", "imports") for i in range(7)], ("p1", "q", "queue-produces"), ("p2", "q", "queue-produces"), ("q", "w", "queue-consumes"), ("x", "q", "queue-consumes"), ("c0", "w", "imports", None, "test"), ("c0", "p1", "imports", None, "admin")]
    e = edges(spark, *rows)

    def routes(*more, **named):
        return ids(traverse.trace(n, e, *more, **named), "route")

    assert routes("c1") == ["c1>c2>c3>c4>c5>c6"]
    assert routes("c2", direction="backward") == ["c2>c1>c0"]
    assert routes("x") == ["x>q>p1", "x>q>p2", "x>q>w"]
    assert routes("w", 3, "backward") == ["w>c0", "w>q>p1>c0", "w>q>p2", "w>q>x"]
    assert routes("p1", 2) == ["p1>q>w"]
    assert routes("c0", 1, "both", "production") == ["c0>c1", "c0>p1"] and routes("c0", 1, classification="test") == ["c0>w"]
    assert routes("c2", 1, "both") == ["c2>c1", "c2>c3"]


@pytest.mark.parametrize("limit", (1 << 19, 0))
def test_reachability_by_one_task_and_in_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(traverse, "PAIRS_OF_ONE_TASK", limit)
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("x", "b"), ("d", "b"), ("y", "z"), (None, "b"), ("d", None))
    assert ids(traverse.reachable(e, spark.createDataFrame([("a",), (None,), ("a",)], "id string")), "id") == ["a", "b", "c", "d"]
    chain = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(14)])
    assert len(ids(traverse.reachable(chain, spark.createDataFrame([("n0",)], "id string")), "id")) == 15
    assert ids(traverse.reachable(e, spark.createDataFrame([], "id string")), "id") == []


def test_entry_points(spark):
    """Reasons in their order; folders of these names deeper down, hooks and tools are ordinary code."""
    paths = {
        "src/__tests__/a.ts": "test-file", "test/b.py": "test-file", "src/c.spec.mts": "test-file", "app/blog/page.tsx": "framework-route", "web/src/app/layout.js": "framework-route", "pages/index.tsx": "framework-route",
        "middleware.ts": "framework-route", "web/vitest.config.ts": "tooling-config", "packages/x/scripts/run.py": "executable-dir", "web/components/pages/Landing.tsx": None, "src/lib/pages/Profile.tsx": None, "web/hooks/use.ts": None, "tools/x.ts": None, "src/app/util.ts": None, "src/index.ts": None,
    }
    rows = [(f"n{i}", "component", "backend", p, {"name": "thing"}) for i, p in enumerate(paths)]
    more = [("t", "worker", "backend", None, {"name": "w"}), ("m", "component", "backend", None, {"name": "ShopApp"}), ("g", "component", "backend", None, {"name": "x", "tags": ["route"]}), ("i", "npm", "external", None, {"name": "x"}), ("q", "queue", "queue", None, {"name": "Domain"}), ("d", "component", "backend", "./src/cli/main.ts", {"name": "x"})]
    got = dict(ids(traverse.entry_points(nodes(spark, *rows, *more)), "id", "reason"))
    want = {f"n{i}": r for i, r in enumerate(paths.values()) if r} | {"t": "component-type", "m": "name-pattern", "g": "tag", "i": "infra-layer"}
    assert got == want
    declared = spark.createDataFrame([("r", "src/cli/main.ts", "package-entry"), ("other", "x", "package-entry")], "repo string, path string, source string")
    assert dict(ids(traverse.entry_points(nodes(spark, *rows, *more), declared), "id", "reason")) == want | {"d": "package-entry"}


def test_dead_code(spark):
    own = lambda i, f="src/x.ts": (i, "component", "backend", f, {"name": i})
    n = nodes(spark, ("cron", "cron", "backend", None), own("used"), own("dead"), own("deadtoo"), own("alone"), own("manifest", "web/package.json"), own("vendored", "a/third_party/x.ts"), own("copied", "web/packages/react/index.js"), own("ours", "web/packages/mine/index.js"), ("lib", "npm", "backend", None, {"name": "react"}))
    e = edges(spark, ("cron", "used"), ("dead", "deadtoo"), ("dead", "used"), ("manifest", "used"), ("vendored", "used"), ("copied", "used"), ("ours", "used"), ("lib", "used"))
    assert ids(traverse.transitively_dead(n, e), "component_id") == ["dead", "deadtoo", "ours"]
    assert dict(ids(traverse.reachability_report(n, e), "item", "value")) == {"entry:component-type": 1, "considered": 6, "suppressed:vendored": 2, "suppressed:dependency-manifest": 1}
    assert ids(traverse.transitively_dead(n.where("component_id <> 'cron'"), e), "component_id") == []


@pytest.mark.parametrize("limit", (1 << 19, 0))
def test_cyclic_sets(spark, monkeypatch, limit):
    import random

    monkeypatch.setattr(traverse, "PAIRS_OF_ONE_TASK", limit)
    pairs = [("b", "a"), ("a", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "f"), ("g", "a"), (None, "a"), ("h", "i")]
    assert ids(traverse.cyclic_sets(edges(spark, *pairs)), "id", "cycle") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert ids(traverse.cyclic_sets(edges(spark, ("a", "b"), ("b", "c"))), "id") == []
    r = random.Random(4)
    some = [(f"n{r.randrange(14):02d}", f"n{r.randrange(14):02d}") for _ in range(20)]
    reach = set(some)
    while True:
        more = {(a, d) for a, b in reach for c, d in some if b == c} - reach
        if not more:
            break
        reach |= more
    want = sorted((a, min(b for x, b in reach if x == a and (b, a) in reach)) for a in {x for x, y in reach if any((y, x) in reach and x != y for y in {q for p, q in reach if p == x})} for _ in (0,))
    assert ids(traverse.cyclic_sets(edges(spark, *some)), "id", "cycle") == want


def test_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("d", "a"))
    assert ids(traverse.short_cycles(e), "cycle", "length") == [("a>b", 2), ("a>b>c", 3)]
    assert ids(traverse.in_cycle(e), "id") == ["a", "b", "c"]


def test_trimming_ends_or_fails(spark):
    chain = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(9)])
    assert ids(traverse.in_cycle(chain), "id") == []
    with pytest.raises(RuntimeError):
        traverse.in_cycle(chain, 2)


def test_pagerank_sums_to_one_and_is_suppressed_when_small(spark):
    n = nodes(spark, *[(f"n{i}", "component", None, None) for i in range(25)])
    e = edges(spark, *[(f"n{i}", f"n{(i * 7 + 1) % 25}") for i in range(20)], ("n1", "n1"), ("n2", "gone"), *[(f"n{i}", "n3") for i in range(10)])
    rows = traverse.pagerank(n, e, 8).collect()
    assert sum(r["rank"] for r in rows) == pytest.approx(1, abs=1e-6) and max(rows, key=lambda r: r["rank"])["component_id"] == "n3"
    assert traverse.pagerank(n.limit(19), e).count() == 0


def test_pagerank_runs_until_it_converges(spark):
    """A chain into a ring and a hub, beside power iteration to the end."""
    ids_ = [f"n{i}" for i in range(30)]
    pairs = [*[(f"n{i}", f"n{i + 1}") for i in range(25)], ("n25", "n20"), *[(f"n{i}", "n0") for i in range(26, 30)]]
    got = {r["component_id"]: r["rank"] for r in traverse.pagerank(nodes(spark, *[(x, "component", None, None) for x in ids_]), edges(spark, *pairs)).collect()}
    out = {x: [b for a, b in pairs if a == x] for x in ids_}
    want = dict.fromkeys(ids_, 1 / 30)
    for _ in range(400):
        lost = sum(want[x] for x in ids_ if not out[x])
        want = {x: 0.15 / 30 + 0.85 * lost / 30 + 0.85 * sum(want[a] / len(out[a]) for a, b in pairs if b == x) for x in ids_}
    assert sum(abs(got[x] - want[x]) for x in ids_) < 1e-5


def test_communities_end_without_change_or_in_turns(spark):
    """Labels walk along a chain with a tail of ties; a star's ends and middle change places for ever."""
    cliques = [(f"c{k}{i}", f"c{k}{j}") for k in range(2) for i in range(3) for j in range(i)]
    chain = [(f"p{i:02}", f"p{i + 1:02}") for i in range(12)] + [(f"p{i:02}", f"p{i + 2:02}") for i in range(11)]
    star = [("s0", f"s{i}") for i in range(1, 5)]
    pairs = cliques + chain + star
    ids_ = sorted({x for p in pairs for x in p})
    near = {x: {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x} for x in ids_}
    vote = lambda l: {x: min(near[x], key=lambda y: (-sum(l[z] == l[y] for z in near[x]), l[y])) for x in ids_}
    seen = [{x: x for x in ids_}]
    while True:
        seen.append({x: seen[-1][y] for x, y in vote(seen[-1]).items()})
        if seen[-1] == seen[-2] or len(seen) > 2 and seen[-1] == seen[-3]:
            break
    assert len(seen) > 7
    got = {r["component_id"]: r["community"] for r in traverse.communities(nodes(spark, *[(x, "component", None, None) for x in ids_]), edges(spark, *pairs)).collect()}
    assert got == {x: min(seen[-1][x], seen[-2][x]) for x in ids_}
    assert len({got[f"s{i}"] for i in range(5)}) == 1


def test_communities_and_modularity(spark):
    cliques = [list("abcd"), list("wxyz")]
    n = nodes(spark, *[(x, "component", None, None) for c in cliques for x in c])
    e = edges(spark, *[p for c in cliques for p in itertools.permutations(c, 2)], ("a", "w"))
    labels = traverse.communities(n, e)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r["community"], set()).add(r["component_id"])
    assert sorted(map(sorted, groups.values())) == cliques
    m = 25
    want = 24 / m - (13 * 12 + 12 * 13) / (m * m)
    assert traverse.modularity(e, labels).first()["q"] == pytest.approx(want, abs=1e-6)


def test_rules(spark):
    n = nodes(
        spark, ("fe", "component", "frontend", "src/ui/fe.ts"), ("core", "component", "backend", "src/core/core.ts"), ("db", "database", "database", None), ("lone", "npm", "external", None),
        ("old", "npm", "external", None, {"status": "deprecated"}), ("svc", "service", "backend", None, {"name": "Mailer"}), *[(f"u{i}", "component", "frontend", f"src/web/u{i}.ts") for i in range(8)],
    )
    e = edges(spark, ("fe", "db", "service-call"), ("fe", "core"), ("core", "fe"), *[(f"u{i}", "svc", "service-call", None, None, "const m = new Mailer(x)" if i < 2 else "Mailer.shared") for i in range(6)], *[(f"u{i}", "fe") for i in range(6)], *[("u7", f"u{i}") for i in range(6)], ("u7", "fe"), ("u7", "core"))
    got = {(r["rule_id"], r["component_id"]) for r in rules.builtin_rules(n, e).collect()}
    assert {("orphan-component", "lone"), ("orphan-component", "old"), ("deprecated-dependency", "old"), ("database-no-backend", "db"), ("frontend-direct-db", "fe"), ("single-point-of-failure", "svc"), ("hotspot-module", "fe"), ("high-fan-out", "u7"), ("shallow-module", "u7"), ("layer-violation", "fe"), ("layer-violation", "u7"), ("duplicate-resource-creation", "svc")} <= got
    assert ("layer-violation", "core") not in got and ("orphan-component", "db") not in got
    custom = spark.createDataFrame([("x", "frontend", None, None, None, "database", None), ("y", None, None, "U7", None, None, "cor")], "id string, from_layer string, from_type string, from_name string, to_layer string, to_type string, to_name string")
    hits = {(r["rule_id"], r["connection_id"]) for r in rules.forbidden_edges(n, e, custom).collect()}
    assert hits == {("x", "E1"), ("y", "E23")}


def test_classification_is_path_before_pattern(spark):
    n = nodes(spark, ("a", "component", None, "src/x.test.ts"), ("b", "component", None, "src/b.ts"), ("adminpanel", "component", None, None))
    e = edges(spark, ("a", "b", None, "src/migrations/1.ts"), ("b", "a", None, "src/b.ts"), ("a", "b", None, None), ("b", "adminpanel"), ("gone", "b", None, "scripts/run.ts"), ("gone", "b", None, "src/admin/run.ts"))
    got = [(r["class"], r["class_confidence"]) for r in rules.classify_edges(n, e).orderBy("connection_id").collect()]
    assert got == [("migration", 0.9), ("production", 0.4), ("test", 0.9), ("admin", 0.7), ("dev-only", 0.8), ("production", 0.4)]


def test_resolve_steps(spark):
    n = nodes(spark, ("C1", "npm", None, None, {"name": "Queue"}), ("C2", "infra", None, "ops/rail.toml", {"name": "Railway Config"}), ("C3", "npm", None, "src/mail/send.ts", {"name": "message-queue-worker"}), ("C4", "npm", None, None, {"name": "queue-x"}))
    e = edges(spark, ("C1", "C3"), ("C2", "C3"))
    q = spark.createDataFrame([(x,) for x in ("C2", "QUEUE", "./src/mail/send.ts", "queue-", "railway", "worker", "mail/se", "nothing", "")], "query string")
    got = dict((r["query"], (r["component_id"], r["step"])) for r in catalog.resolve(n, e, q).collect())
    assert got == {"C2": ("C2", 1), "QUEUE": ("C1", 2), "./src/mail/send.ts": ("C3", 3), "queue-": ("C3", 4), "railway": ("C2", 4), "worker": ("C3", 4), "mail/se": ("C3", 6)}


def test_find_and_candidates(spark):
    n = nodes(spark, ("1", "npm", None, None, {"name": "mail"}), ("2", "npm", None, None, {"name": "mail-sender", "tags": ["Mail"]}), ("3", "npm", None, None, {"name": "other", "purpose": "sends mail"}), ("4", "npm", None, None, {"name": "m-a-x-i-l"}), ("5", "npm", None, None, {"name": "zzz"}))
    assert [(r["component_id"], r["score"]) for r in catalog.find_components(n, "Mail").collect()] == [("1", 130), ("2", 104), ("3", 20), ("4", 4)]
    assert [r["name"] for r in catalog.candidates(n, "mailx").collect()][:1] == ["mail"]
    assert catalog.find_components(n, "  ").count() == 0


def test_aliases_and_dead(spark):
    n = nodes(spark, ("1", "infra", None, None, {"name": "Railway"}), ("2", "infra", None, None, {"name": "Railway Config"}), ("3", "infra", None, None, {"name": "railway (infra)"}), ("4", "npm", None, None, {"name": "bullmq@5.1"}), ("5", "pip", None, None, {"name": "x"}))
    e = edges(spark, ("2", "9"), ("8", "2"))
    assert ids(catalog.merge_aliases(n, e), "base", "component_id", "members") == [("bullmq", "4", 1), ("railway", "2", 3), ("x", "5", 1)]
    assert ids(catalog.dead_components(n, e), "component_id") == ["1", "3", "4"]


def test_dedup_merge_and_integrity(spark):
    rows = spark.createDataFrame([(1, "k", 0.5, "a"), (2, "k", 0.9, "b"), (3, "k", 0.9, "c"), (4, None, None, "d"), (5, None, 0.1, "e")], "seq long, key string, confidence double, v string")
    assert ids(merge.best_per_key(rows, ["key"]), "v") == ["b", "e"]
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("", 1, 3)], "id string, v int, seq long")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 9, 3)], "id string, v int, seq long")
    assert ids(merge.merge_latest(old, new, "id"), "id", "v") == [("a", 1), ("b", 3), ("c", 9)]
    n = nodes(spark, ("a", "component", None, "src/a.ts"), ("b", "component", None, "./src/b.ts"))
    e = edges(spark, ("a", "FILE:src/b.ts"), ("gone", "a", None, "src/a.ts"), ("a", None))
    assert ids(merge.integrity_issues(n, e), "connection_id", "end", "id") == [("E2", "from", "gone")]
    assert [r["to_id"] for r in merge.resolve_file_nodes(n, e).orderBy("connection_id").collect()] == ["b", "a", None]
    kept, rest = merge.keep_unchanged(n, e, spark.createDataFrame([("src/a.ts",)], "path string"))
    assert ids(kept, "component_id") == ["b"] and ids(rest, "connection_id") == []


def test_versions_freshness_and_modes(spark):
    pairs = spark.createDataFrame([("1.2.3", "2.0.0"), ("v1.2.3", "1.3.0"), ("1.2.3", "1.2.9"), ("x", "1.0.0"), (None, "1.0.0")], "a string, b string")
    assert [r[0] for r in pairs.select(history.bump_class(F.col("a"), F.col("b"))).collect()] == ["major", "minor", "patch", "minor", "minor"]
    n = nodes(spark, ("a", "npm", None, None, {"version": "1.0.0"}), ("b", "npm", None, None, {"version": "2.0.0"}), ("c", "npm", None, None, {"version": "1.0.0"}), ("d", "npm", None, None), ("e", "database", None, None))
    latest = spark.createDataFrame([("a", "npm", "1.0.0", T), ("b", "npm", "10.0.0", T), ("d", "npm", "1.0.0", T - dt.timedelta(days=30))], "name string, component_type string, latest_version string, checked_at timestamp")
    got = {r["component_id"]: (r["freshness"], r["bump"]) for r in history.freshness(n, latest, "2025-01-03", 7).collect()}
    assert got == {"a": ("current", None), "b": ("stale", "major"), "c": ("unresolved", None), "d": ("drifting", None)}
    base = {"flag": None, "has_index": True, "schema_version": "1.1.0", "drift_breach": False, "added": 0, "changed": ["src/a.ts"], "full_scan_age_hours": 1, "incrementals": 0}
    cases = [{"flag": "full"}, {"has_index": False}, {"flag": "incremental", "drift_breach": True}, {"schema_version": "2.0"}, {"drift_breach": True}, {"changed": ["web/package.json"]}, {"added": 1}, {"full_scan_age_hours": 169}, {"incrementals": 20}, {"changed": []}, {}]
    state = spark.createDataFrame([(str(i), *({**base, **c}).values()) for i, c in enumerate(cases)], "repo string, flag string, has_index boolean, schema_version string, drift_breach boolean, added long, changed array<string>, full_scan_age_hours long, incrementals long")
    got = [r["reason"] for r in history.scan_modes(state).orderBy(F.col("repo").cast("int")).collect()]
    assert got == ["flag-full", "no-prior-state", "flag-incremental", "schema-mismatch", "audit-drift-breach", "manifest-changed", "new-files", "stale-full", "incremental-cap", "no-changes", "fast-path"]
    urls = spark.createDataFrame([("https://github.com/o/r.git",), ("git@gitlab.com:o/r",), ("https://x.test/o/r",)], "u string")
    assert [r[0] for r in urls.select(history.owner_and_repo(F.col("u"))).collect()] == ["o/r", "o/r", None]


def test_audit_numbers(spark):
    lots = spark.createDataFrame([(1,), (8,), (9,), (120,), (40000,)], "lot long")
    assert [(r["code_letter"], r["sample"], r["accept"]) for r in audit.aql_plan(lots).orderBy("lot").collect()] == [("A", 1, 0), ("A", 2, 0), ("B", 3, 0), ("F", 20, 1), ("N", 500, 21)]
    one = spark.range(1)
    assert one.select(audit.cochran(0.5, 0.05, F.lit(None).cast("long"))).first()[0] == 385 and one.select(audit.cochran(0.5, 0.05, F.lit(1000))).first()[0] == 278
    assert one.select(audit.binomial_cdf(F.lit(1), F.lit(20), 0.05)).first()[0] == pytest.approx(0.735839520, abs=1e-8)
    v = lambda d, n: one.select(audit.sprt(F.lit(d), F.lit(n), 0.01, 0.05)).first()[0]
    assert (v(0, 100), v(6, 60), v(1, 30)) == ("accept", "reject", "continue")
    strata = spark.createDataFrame([("a", 100, 1.0), ("b", 100, 3.0), ("c", 5, 50.0)], "stratum string, size long, spread double")
    got = audit.neyman(strata, 60).collect()
    assert sum(r["allocated"] for r in got) == 60 and all(r["allocated"] <= r["size"] for r in got) and {r["stratum"]: r["allocated"] for r in got}["c"] == 5
    flat = audit.neyman(strata.withColumn("spread", F.lit(0.0)), 10).collect()
    assert [r["allocated"] for r in flat] == [4, 3, 3]
    rows = spark.range(500).selectExpr("id", "case when id % 5 = 0 then 'x' else 'y' end as s")
    sample = audit.stratified_sample(rows, "id", "s", 7).collect()
    assert len({r["id"] for r in sample}) == 14 and sorted((r["s"], r["position"]) for r in sample) == [(s, i) for s in "xy" for i in range(1, 8)]


def test_use_cases_and_prompts(spark):
    n = nodes(spark, ("m1", "llm", "external", None, {"name": "OpenAI"}), ("m2", "llm", "external", None, {"name": "LangSmith"}), ("x", "service", "external", None))
    rows = [("m1", "src/ai/rank.ts", "rerankHits", "service-call", None), ("m1", "src/ai/rank.ts", "rerankHits", "service-call", "production"), ("m2", "src/ai/rank.ts", "traceable", "service-call", None), ("m1", "src/queue/x.ts", "run", "service-call", None), ("m1", "src/t.ts", "summarize", "service-call", "test"), ("m1", "src/i.ts", "summarize", "imports", None), ("m1", "src/ai/rank.ts", "openai", "imports", None), ("m1", "src/lib/mine.ts", "create", "service-call", None), ("x", "src/z.ts", "chat", "service-call", None)]
    e = spark.createDataFrame([(i, "r", f, s, t, k, c) for i, (t, f, s, k, c) in enumerate(rows)], "seq long, repo string, file string, symbol string, to_id string, connection_type string, classification string")
    prompts = spark.createDataFrame([(1, "r", "src/p.md", ["src/lib/mine.ts", None], "translation"), (2, "r", None, ["src/lib/mine.ts"], "chat"), (3, "r", "src/queue/x.ts", None, "unknown")], "seq long, repo string, file string, used_by array<string>, category string")
    got = {r["file"]: (r["call_sites"], r["providers"], r["main_provider"], r["purpose"], r["grouped_by"]) for r in estate.use_cases(n, e, prompts).collect()}
    assert got == {"src/ai/rank.ts": (3, 2, "OpenAI", "reranking", "function"), "src/queue/x.ts": (1, 1, "OpenAI", "queue-processing", "file"), "src/lib/mine.ts": (1, 1, "OpenAI", "translation", "prompt")}
    texts = spark.createDataFrame([(1, "Summarize {{ doc }} and ${doc} in {lang}"), (2, None), (3, "Write code"), (4, "hi")], "seq long, content string")
    assert ids(estate.template_variables(texts, "seq", "content"), "seq", "variable") == [(1, "doc"), (1, "lang")]
    assert [r[0] for r in texts.orderBy("seq").select(estate.prompt_category(F.col("content"))).collect()] == ["summarization", "unknown", "code-generation", "unknown"]


def test_service_calls(spark):
    """Confidence by place, file and imports of the whole file; comments, examples and test files give nothing."""
    proof = "import OpenAI from 'openai'\n"
    files = [
        ("src/a.ts", proof + "const c = new OpenAI()\nawait openai.chat.completions.create({})"), ("src/b.ts", "// new Stripe(key)\nconst s = new Stripe(key)\nlog('x') // new Stripe(k)\nexample: 'new Stripe('"), ("src/c.ts", "say('use new Stripe(key)')"),
        ("src/__tests__/d.ts", "new Stripe(k)"), ("lib/dist/e.js", "import s from 'stripe'\nnew Stripe(k)"), ("docs/f.md", "new Stripe(k)"), ("src/g.py", None), ("src/h.ts", ""), ("src/i.ts", "const w = new Worker(x, y); new Queue(z)\nimport { Queue } from 'bullmq'"),
    ]
    df = spark.createDataFrame([(i, f, t, "clash") for i, (f, t) in enumerate(files)], "file_id long, file string, content string, service string")
    got = {(r["file_id"], r["line"], r["service"], r["confidence"]) for r in services.service_calls(df).collect()}
    assert got == {(0, 1, "OpenAI", 0.9), (0, 2, "OpenAI", 0.9), (0, 3, "OpenAI", 0.9), (1, 2, "Stripe", 0.7), (4, 2, "Stripe", 0.6), (8, 1, "BullMQ", 0.9), (8, 2, "BullMQ", 0.9)}


def test_plain_texts_of_service_patterns():
    assert services.literals_of(r"from\s+['\"]ai['\"]") == {"'ai'", '"ai"'} and services.literals_of(r"\bnew\s+Ollama\(") == {"Ollama("} and services.literals_of(r"127\.0\.0\.1:11434") == {"127.0.0.1:11434"}
    assert all(min(map(len, services.literals_of(p))) >= 4 for _, _, patterns, _ in services.SERVICES for p in patterns)


def test_extraction(spark):
    files = spark.createDataFrame([("r", "src/a/x.ts", 1, "typescript", "import { q } from './y';\nimport z from '../b/z.js'\nexport * from '@/c'\nimport React from 'react/jsx'\nconst p = require('pg')\n"), ("r", "src/a/y.ts", 2, "typescript", None), ("r", "src/b/z.ts", 3, "typescript", ""), ("r", "src/c/index.ts", 4, "typescript", "")], "repo string, file string, file_id long, code_lang string, content string")
    found = extract.imports(files)
    assert ids(found, "line", "kind", "target") == [(1, "from", "./y"), (2, "from", "../b/z.js"), (3, "from", "@/c"), (4, "from", "react/jsx"), (5, "require", "pg")]
    assert ids(extract.resolve_imports(found, files), "line", "to_file") == [(1, "src/a/y.ts"), (2, "src/b/z.ts"), (3, "src/c/index.ts")]
    assert ids(found.select(extract.package_of(F.col("target")).alias("p")).where("p is not null"), "p") == ["pg", "react"]
    paths = spark.createDataFrame([("src/ui/index.ts",), ("lib/db/Model.py",), ("main.rs",)], "f string")
    assert [tuple(r) for r in paths.select(extract.module_name(F.col("f")), extract.module_layer(F.col("f"))).collect()] == [("ui", "frontend"), ("db/Model", "database"), ("main", "backend")]
    code = spark.createDataFrame([(1, "mysql://u:p@DB.host:3306/shop"), (2, "fetch('https://a.test/v1?x=1')"), (3, "no url"), (4, None)], "seq long, code string")
    got = extract.addresses(code, "seq", "code").orderBy("seq").collect()
    assert [(r["protocol"], r["host"], r["port"], r["database"], r["path"], r["resource"]) for r in got] == [("mysql", "db.host", 3306, "shop", None, "database"), ("https", "a.test", None, None, "/v1", "api")]
    manifests = spark.createDataFrame([(1, '{"dependencies": {"a": "^1.2.0"}, "devDependencies": {"a": "~2.0.0", "b": "3"}}'), (2, "{broken"), (3, None)], "id long, text string")
    assert ids(extract.npm_manifest(manifests, "id", "text"), "package", "version", "scope") == [("a", "1.2.0", "core"), ("a", "2.0.0", "dev"), ("b", "3", "dev")]
    pip = spark.createDataFrame([(1, "# c\n-r x\nFlask[async]>=2.0,<3\nnumpy\n")], "id long, text string")
    assert [(r["package"], r["version"]) for r in extract.pip_requirements(pip, "id", "text").collect()] == [("flask", "2.0"), ("numpy", None)]
    assert ids(extract.procfile(spark.createDataFrame([(1, "web: run\nmy-worker: go\nrelease: x")], "id long, text string"), "id", "text"), "process", "kind") == [("my-worker", "worker"), ("release", "other"), ("web", "web")]
    a = spark.createDataFrame([("M", "id", "string"), ("M", "n", "int"), ("M", "gone", "int")], "model string, field string, type string")
    b = spark.createDataFrame([("M", "id", "String"), ("M", "n", "string"), ("M", "new", "int")], "model string, field string, type string")
    assert ids(extract.compare_fields(a, b), "field", "verdict") == [("gone", "missing"), ("id", "match"), ("n", "mismatch"), ("new", "extra")]


def test_deep_and_dotted_folders_are_folded(spark):
    files = spark.createDataFrame([("r", "a/b/c/d/e/f/x.ts", 1, "typescript", "import y from '../../../../../../y'\nimport z from '../../../z'\n"), ("r", ".conf/in/w.ts", 2, "typescript", "import y from '../../y'\nimport q from '../../../q'\n"), ("r", "y.ts", 3, "typescript", None), ("r", "a/b/c/z.ts", 4, "typescript", None)], "repo string, file string, file_id long, code_lang string, content string")
    got = extract.resolve_imports(extract.imports(files), files)
    assert ids(got, "file_id", "line", "to_file") == [(1, 1, "y.ts"), (1, 2, "a/b/c/z.ts"), (2, 1, "y.ts"), (2, 2, None)]


def test_every_import_role_and_address_of_a_line(spark):
    line = "import a from 'a';import{b}from'./b';import 'c';const d=require('d'),e=require('e');f(import('f'))"
    files = spark.createDataFrame([("r", "x.js", 1, "javascript", line.replace("{b}from", "{b} from ").replace("import{", "import {") + "\nimport os; import sys\n")], "repo string, file string, file_id long, code_lang string, content string")
    assert ids(extract.imports(files), "line", "kind", "target") == [(1, "dynamic", "f"), (1, "from", "./b"), (1, "from", "a"), (1, "require", "d"), (1, "require", "e"), (1, "side-effect", "c"), (2, "module", "os"), (2, "module", "sys")]
    code = spark.createDataFrame([(1, "aQueue.add('x'); bQueue.add('y'); new Worker('q', f, { concurrency: 2 }); new Worker('p', g); new Worker('o', h, { concurrency: 7 })"), (2, None), (3, "redis://h1:1/2 https://h2/p")], "seq long, code string")
    assert ids(extract.queue_roles(code, "seq", "code").na.fill(-1), "queue", "job", "concurrency") == [("a", "x", -1), ("b", "y", -1), ("o", "h", 7), ("p", "g", -1), ("q", "f", 2)]
    assert ids(extract.addresses(code, "seq", "code"), "host", "resource") == [("h1", "cache"), ("h2", "api")]


def test_document_links(spark):
    text = "---\nid: page\ndepends_on: [one, \"two\"]\n---\n# T\nsee [[A|alias]] and `[[no]]` [x](./y.md#z)\n```\n[[code]]\n```\n![i](p.png) [w](https://x) [[B.md]]\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert ids(extract.document_links(docs), "line", "type", "target") == [(6, "markdown-link", "./y.md"), (6, "wikilink", "A"), (10, "wikilink", "B")]
    assert ids(extract.document_relations(docs), "field", "target") == [("depends_on", "one"), ("depends_on", "two")]
    assert ids(extract.document_identities(docs), "identity", "document") == [("page", 1)]


def test_identities(spark):
    names = spark.createDataFrame([("npm", "My Package/@x"), ("npm", "Ünï"), ("npm", ""), ("npm", None), ("npm", "a" * 60)], "k string, n string")
    got = [r[0] for r in names.select(stable_id(F.col("k"), F.col("n"))).collect()]
    assert got[0] == "STABLE_npm_my-package-x" and got[1] == f"STABLE_npm_n-{fnv1a_base36('Ünï')}" and got[2] == got[3] == f"STABLE_npm_h-{fnv1a_base36('')}"
    assert got[4] == f"STABLE_npm_{'a' * 48}-{fnv1a_base36('a' * 60)}" and len(fnv1a_base36("")) == 7
    keys = spark.createDataFrame([("a", "bc", "t", None, 1), ("ab", "c", "t", None, 1), ("a", "bc", "t", None, 1)], "f string, t string, k string, p string, l int")
    out = [r[0] for r in keys.select(edge_id(F.col("f"), F.col("t"), F.col("k"), F.col("p"), F.col("l"))).collect()]
    assert out[0] == out[2] != out[1]


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"component_id": "A", "name": "a", "type": "npm", "role": {"layer": "external", "critical": true}, "source": {"config_files": ["package.json"], "confidence": 0.9}, "timestamp": 1000}\n{torn\n')
    got = jsonl.read_components(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r["component_id"], r["component_type"], r["layer"], r["critical"], r["file"]) for r in got] == [("A", "npm", "external", True, "package.json")]
    n = nodes(spark, ("a", "npm", "external", None), ("b", "service", "backend", None))
    e = edges(spark, ("b", "a", "uses-package"), ("b", "zz"))
    pages = {r["component_id"]: r["page"] for r in jsonl.markdown_views(n, e).collect()}
    assert "## Connected from (1)\n- b" in pages["a"] and "## Connects to (2)\n- a\n- zz" in pages["b"] and pages["a"].startswith("---\nid: a")
    paged = {(r["component_id"], r["page_no"]): r["page"] for r in jsonl.markdown_views(n, e, 1).collect()}
    assert set(paged) == {("a", 1), ("b", 1), ("b", 2)} and paged["b", 1].endswith("## Connects to (2)\n- a") and paged["b", 2].endswith("## Connects to (2)\n- zz")
    jsonl.write_lines(jsonl.compact_lines(n, e), str(tmp_path / "out"))
    assert sorted((r["f"], r["t"]) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("b", "?"), ("b", "a")]
    assert '"command":"x"' in jsonl.envelope(n.select("name"), "x").first()["json"]
    for p in ("web/package.json", "web/node_modules/q/package.json", "svc/Cargo.toml", "web/src/a.ts"):
        (tmp_path / "repo" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / p).write_text("{}")
    (tmp_path / "repo" / ".git").mkdir()
    assert ids(discover.stack_roots(spark, str(tmp_path / "repo")), "path", "stack") == [("svc", "cargo"), ("web", "npm")]
    assert ids(discover.repositories(spark, str(tmp_path)), "path") == ["repo"]
    assert [r["size_bytes"] for r in discover.read_sources(spark, str(tmp_path / "repo" / "web" / "src")).collect()] == [2]
