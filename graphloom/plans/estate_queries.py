"""History, audit, portfolio, prompt and journal queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as a, estate as s, history as h
from ..operators.graph_views import SQL_EDGES, SQL_GRAPH, SQL_NODES, edges, nodes, sql_clean_path
from ..session import table

AS_OF, SNAP_AT, SCAN_AT = "2026-01-01 00:00:00", "2025-03-01 00:00:00", "2025-06-01 00:00:00"
SAMPLE, SAMPLED_TOTAL = 20, 500


def _snap(spark, d):
    return table(spark, d, "component_snapshots")


def _latest_versions(n):
    """The newest version (by its three numbers) that any repo has of a package stands for the registry's record."""
    return n.where("version is not null").groupBy("name", "component_type").agg(F.max_by("version", F.struct(h.version_key(F.col("version")).alias("k"), "version")).alias("latest_version"), F.max("first_seen_at").alias("checked_at"))


def snapshot_significance(spark, d):
    return h.significance(_snap(spark, d))


def snapshot_timeline(spark, d):
    return h.timeline(_snap(spark, d))


def component_first_seen(spark, d):
    return h.first_seen(_snap(spark, d))


def snapshot_state(spark, d):
    return h.state_at(_snap(spark, d), SNAP_AT)


def version_bumps(spark, d):
    return h.version_bumps(_snap(spark, d))


def file_changes(spark, d):
    return h.file_changes(table(spark, d, "source_files"), SCAN_AT)


def package_freshness(spark, d):
    n = nodes(spark, d, "name", "component_type", "version", "first_seen_at")
    return h.freshness(n, _latest_versions(n), AS_OF, 180)


def audit_plans(spark, d):
    lots = edges(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("lot"), F.count_if(F.col("confidence") < 0.5).alias("defects"))
    planned = a.aql_plan(lots.select("repo", "lot", "defects"))
    return planned.select("repo", "lot", "code_letter", "sample", "accept", a.sprt(F.col("defects"), F.col("lot"), 0.05, 0.15).alias("verdict"), a.cochran(0.05, 0.05, F.col("lot")).alias("cochran"))


def audit_acceptance(spark, d):
    planned = a.aql_plan(edges(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("lot")))
    return planned.select("repo", F.round(a.binomial_cdf(F.col("accept"), F.col("sample"), 0.025), 9).alias("accepts"))


def audit_strata(spark, d):
    e = edges(spark, d).select(F.lit("connection").alias("entity"), a.case_of(F.col("connection_type"), a.CONNECTION_STRATA).alias("stratum"))
    n = nodes(spark, d).select(F.lit("component").alias("entity"), a.case_of(F.col("component_type"), a.COMPONENT_STRATA).alias("stratum"))
    return e.unionByName(n).groupBy("entity", "stratum").agg(F.count(F.lit(1)).alias("rows"))


def audit_allocation(spark, d):
    e = edges(spark, d).groupBy(a.case_of(F.col("connection_type"), a.CONNECTION_STRATA).alias("stratum")).agg(F.count(F.lit(1)).alias("size"), F.round(F.stddev_pop("confidence"), 6).alias("spread"))
    return a.neyman(e, SAMPLED_TOTAL)


def audit_sample(spark, d):
    return a.stratified_sample(edges(spark, d), "connection_id", "connection_type", SAMPLE)


def audit_wrong_endpoints(spark, d):
    return a.wrong_endpoints(edges(spark, d), table(spark, d, "source_files"))


def audit_missing_files(spark, d):
    return a.missing_files(nodes(spark, d), table(spark, d, "source_files"))


def audit_collisions(spark, d):
    return a.collisions(table(spark, d, "connections"), ["from_id", "to_id", "connection_type", "file", "line"], "seq").select("from_id", "to_id", "connection_type", "file", "line", "extra", "first")


def error_drift(spark, d):
    ev = table(spark, d, "events")
    daily = ev.groupBy(F.lit("all").alias("stratum"), F.to_date("ts").alias("day")).agg(F.round(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)), 9).alias("rate"))
    return a.ewma(daily, "stratum", "day", "rate")


def llm_use_cases(spark, d):
    e = edges(spark, d, "seq", "repo", "file", "symbol", "to_id", "connection_type", "classification")
    return s.use_cases(nodes(spark, d, "name", "component_type"), e, table(spark, d, "prompts"))


def shared_dependencies(spark, d):
    return s.shared_dependencies(nodes(spark, d))


def cross_repo_services(spark, d):
    return s.service_calls(nodes(spark, d), edges(spark, d))


def cross_repo_service_members(spark, d):
    return s.service_members(nodes(spark, d))


def portfolio_status(spark, d):
    return s.portfolio_status(nodes(spark, d), edges(spark, d), AS_OF)


def prompt_summary(spark, d):
    return s.prompt_summary(table(spark, d, "prompts"))


def prompt_variables(spark, d):
    return s.template_variables(table(spark, d, "prompts"), "seq", "content")


def user_memory(spark, d):
    return s.user_memory(table(spark, d, "events"))


def last_events(spark, d):
    return s.last_events(table(spark, d, "events"))


def journal_health(spark, d):
    return s.journal_health(table(spark, d, "events"))


def user_sessions(spark, d):
    return s.sessions(table(spark, d, "events"))


def daily_windows(spark, d):
    ev = table(spark, d, "events")
    return ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "value")


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_significance, snapshot_timeline, component_first_seen, snapshot_state, version_bumps, file_changes, package_freshness, audit_plans, audit_acceptance, audit_strata, audit_allocation,
        audit_sample, audit_wrong_endpoints, audit_missing_files, audit_collisions, error_drift, llm_use_cases, shared_dependencies, cross_repo_services, cross_repo_service_members, portfolio_status,
        prompt_summary, prompt_variables, user_memory, last_events, journal_health, user_sessions, daily_windows,
    )
}


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _strata(column: str, strata) -> str:
    return "CASE " + " ".join(f"WHEN {column} IN ({_list(v)}) THEN '{k}'" for k, v in strata.items()) + " ELSE '__other' END"


_SEM = r"^[^0-9]*([0-9]+)\.([0-9]+)\.([0-9]+)"
_PART = lambda v, i: f"TRY_CAST(nullif(regexp_extract({v}, '{_SEM}', {i}), '') AS BIGINT)"
_BUMP = lambda x, y: f"CASE WHEN {_PART(x, 1)} IS NULL OR {_PART(y, 1)} IS NULL THEN 'minor' WHEN {_PART(y, 1)} > {_PART(x, 1)} THEN 'major' WHEN {_PART(y, 2)} > {_PART(x, 2)} THEN 'minor' ELSE 'patch' END"
_PAIRS = """
WITH latest AS (
  SELECT * FROM component_snapshots WHERE snapshot_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, component_id ORDER BY delivered_at DESC NULLS LAST, seq DESC) = 1),
heads AS (SELECT snapshot_id, min(repo) AS repo, min(taken_at) AS taken_at FROM component_snapshots WHERE snapshot_id IS NOT NULL GROUP BY 1),
prev AS (SELECT snapshot_id, lag(snapshot_id) OVER (PARTITION BY repo ORDER BY taken_at, snapshot_id) AS previous_id FROM heads),
a AS (SELECT p.snapshot_id AS at, l.* FROM prev p JOIN latest l USING (snapshot_id) WHERE p.previous_id IS NOT NULL),
b AS (SELECT p.snapshot_id AS at, l.* FROM prev p JOIN latest l ON l.snapshot_id = p.previous_id),
pairs AS (SELECT coalesce(a.at, b.at) AS snapshot_id, b.at IS NULL AS added, a.at IS NULL AS removed, a.layer AS al, b.layer AS bl, a.component_type AS at_, a.version AS av, b.version AS bv,
  a.at IS NOT NULL AND b.at IS NOT NULL AND (a.version IS DISTINCT FROM b.version OR a.status IS DISTINCT FROM b.status OR a.layer IS DISTINCT FROM b.layer OR a.critical IS DISTINCT FROM b.critical OR a.component_type IS DISTINCT FROM b.component_type) AS modified
  FROM a FULL JOIN b ON a.at = b.at AND a.component_id = b.component_id)
"""
_AQL = "CASE " + " ".join(f"WHEN lot <= {t} THEN {{'l': '{c}', 'n': {n}, 'c': {k}}}" for t, c, n, k in a.AQL_PLANS if t) + " ELSE {'l': 'N', 'n': 500, 'c': 21} END"


def _purpose(symbol: str, file: str) -> str:
    base = rf"regexp_replace(string_split({file}, '/')[-1], '\.[^.]+$', '')"
    parts = [f"WHEN regexp_matches(lower({w}), '{p}') THEN '{n}'" for w in (symbol, base) for p, n in s.PURPOSES]
    return "CASE " + " ".join(parts + [f"WHEN regexp_matches(lower({file}), '{p}') THEN '{n}'" for p, n in s.FOLDERS]) + " END"


def _category(content: str) -> str:
    low = f"lower({content})"
    parts = [f"WHEN regexp_matches({low}, '{p}') THEN '{n}'" for p, n in s.PROMPT_CATEGORIES]
    parts[4:4] = [f"WHEN contains({low}, 'code') AND regexp_matches({low}, 'write|generate') THEN 'code-generation'", f"WHEN contains({low}, 'code') AND contains({low}, 'review') THEN 'code-review'"]
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


_LN = __import__("math").log
_P0, _P1 = 0.05, 0.15

_VERSION = lambda v: "[" + ", ".join(f"coalesce(try_cast(nullif(regexp_extract({v}, '^[^0-9]*([0-9]+)(?:[.]([0-9]+))?(?:[.]([0-9]+))?', {k}), '') AS BIGINT), 0)" for k in (1, 2, 3)) + "]"

SQL = {
    "snapshot_significance": _PAIRS
    + f""", g AS (SELECT snapshot_id, count(*) FILTER (added) AS added, count(*) FILTER (removed) AS removed, count(*) FILTER (modified) AS modified, count(*) FILTER (NOT added) AS before,
        coalesce(bool_or((added AND coalesce(al, '') IN ({_list(h.CRITICAL_LAYERS)})) OR (removed AND coalesce(bl, '') IN ({_list(h.CRITICAL_LAYERS)}))), false) AS l, coalesce(bool_or(added AND at_ IN ({_list(h.PACKAGE_TYPES)})), false) AS p,
        coalesce(bool_or(modified AND {_PART('bv', 1)} <> {_PART('av', 1)}), false) AS v,
        coalesce(list(DISTINCT coalesce(al, '')) FILTER (added), []) AS "in", coalesce(list(DISTINCT coalesce(bl, '')) FILTER (removed), []) AS "out" FROM pairs GROUP BY 1),
      f AS (SELECT *, (added + removed + modified)::DOUBLE / greatest(before, 1) > 0.2 AS churn, len("in") > 0 AND before > 0 AND len(list_filter("in", lambda x: NOT list_contains("out", x))) > 0 AS fresh FROM g),
      t AS (SELECT *, list_filter([CASE WHEN l THEN 'layer-change' END, CASE WHEN churn THEN 'high-churn' END, CASE WHEN fresh THEN 'new-layer' END, CASE WHEN p THEN 'new-package' END, CASE WHEN v THEN 'version-bump' END], lambda x: x IS NOT NULL) AS ts FROM f)
      SELECT snapshot_id, added, removed, modified, coalesce(CASE WHEN len(ts) = 0 AND added + removed + modified > 0 THEN 'metadata-only' ELSE array_to_string(list_sort(ts), ',') END, '') AS triggers,
        CASE WHEN l OR churn OR fresh THEN 'major' WHEN p OR v THEN 'minor' ELSE 'patch' END AS significance FROM t""",
    "snapshot_timeline": """SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY taken_at DESC, snapshot_id DESC) AS position, snapshot_id, taken_at, components FROM (
      SELECT repo, snapshot_id, taken_at, count(DISTINCT component_id) AS components FROM component_snapshots WHERE snapshot_id IS NOT NULL GROUP BY ALL) QUALIFY position <= 10""",
    "component_first_seen": "SELECT component_id, min(taken_at) AS first_seen, max(taken_at) AS last_seen, count(DISTINCT snapshot_id) AS snapshots FROM component_snapshots WHERE component_id IS NOT NULL GROUP BY 1",
    "snapshot_state": f"""WITH past AS (SELECT * FROM component_snapshots WHERE taken_at <= TIMESTAMP '{SNAP_AT}'), n AS (SELECT repo, arg_max(snapshot_id, {{'t': taken_at, 's': snapshot_id}}) AS snapshot_id FROM past GROUP BY 1),
      r AS (SELECT * FROM past QUALIFY row_number() OVER (PARTITION BY repo, snapshot_id, component_id ORDER BY delivered_at DESC NULLS LAST, seq DESC) = 1)
      SELECT r.repo, r.snapshot_id, count(*) AS components, count(*) FILTER (status = 'active') AS active FROM r JOIN n USING (repo, snapshot_id) GROUP BY 1, 2""",
    "version_bumps": _PAIRS + f"SELECT {_BUMP('bv', 'av')} AS bump, count(*) AS changes FROM pairs WHERE NOT added AND NOT removed AND av IS DISTINCT FROM bv AND av IS NOT NULL GROUP BY 1",
    "file_changes": f"""WITH s AS (SELECT repo, {sql_clean_path('file')} AS path, scanned_at, file_id, sha256(content) AS h FROM source_files WHERE file IS NOT NULL),
      g AS (SELECT repo, path, arg_max({{'h': h}}, {{'t': scanned_at, 'i': file_id}}) FILTER (scanned_at <= TIMESTAMP '{SCAN_AT}') AS a, arg_max({{'h': h}}, {{'t': scanned_at, 'i': file_id}}) AS b FROM s GROUP BY 1, 2)
      SELECT repo, path, CASE WHEN b.h IS NULL AND a.h IS NOT NULL THEN 'removed' WHEN a IS NULL THEN 'added' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'modified' END AS change FROM g""",
    "package_freshness": f"""WITH {SQL_NODES}, l AS (SELECT name, component_type, arg_max(version, {{'k': {_VERSION('version')}, 'v': version}}) AS latest_version, max(first_seen_at) AS checked_at FROM nodes WHERE version IS NOT NULL GROUP BY 1, 2),
      j AS (SELECT n.component_id, n.version, l.* FROM nodes n LEFT JOIN l USING (name, component_type) WHERE n.component_type IN ({_list(h.PACKAGE_TYPES)})),
      f AS (SELECT *, CASE WHEN checked_at IS NULL THEN 'unresolved' WHEN {_VERSION('latest_version')} > {_VERSION('version')} THEN 'stale' WHEN checked_at < TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY THEN 'drifting' ELSE 'current' END AS freshness FROM j)
      SELECT component_id, freshness, CASE WHEN freshness = 'stale' THEN {_BUMP('version', 'latest_version')} END AS bump FROM f""",
    "audit_plans": f"""WITH {SQL_EDGES}, l AS (SELECT repo, count(*) AS lot, count(*) FILTER (confidence < 0.5) AS defects FROM edges GROUP BY 1), p AS (SELECT *, {_AQL} AS p FROM l),
      r AS (SELECT *, defects * {_LN(_P1 / _P0)!r}::DOUBLE + (lot - defects) * {_LN((1 - _P1) / (1 - _P0))!r}::DOUBLE AS ratio, {1.96 * 1.96 * 0.05 * 0.95 / 0.0025!r}::DOUBLE AS n0 FROM p)
      SELECT repo, lot, p.l AS code_letter, least(p.n, greatest(lot, 1)) AS sample, p.c AS accept, CASE WHEN ratio >= {_LN(0.95 / 0.05)!r} THEN 'reject' WHEN ratio <= {_LN(0.05 / 0.95)!r} THEN 'accept' ELSE 'continue' END AS verdict,
        CAST(ceil(n0 / (1 + (n0 - 1) / lot)) AS BIGINT) AS cochran FROM r""",
    "audit_acceptance": f"""WITH {SQL_EDGES}, p AS (SELECT repo, count(*) AS lot, {_AQL.replace('lot', 'count(*)')} AS p FROM edges GROUP BY 1), s AS (SELECT repo, least(p.n, greatest(lot, 1)) AS n, p.c AS c FROM p)
      SELECT repo, round(least(1.0::DOUBLE, list_sum(list_transform(range(0, c + 1), lambda k: CASE WHEN k > n THEN 0.0::DOUBLE ELSE exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.025::DOUBLE) + (n - k) * ln(0.975::DOUBLE)) END))), 9) AS accepts FROM s""",
    "audit_strata": f"""{SQL_GRAPH} SELECT 'connection' AS entity, {_strata('connection_type', a.CONNECTION_STRATA)} AS stratum, count(*) AS rows FROM edges GROUP BY 1, 2
      UNION ALL SELECT 'component', {_strata('component_type', a.COMPONENT_STRATA)}, count(*) FROM nodes GROUP BY 1, 2""",
    "audit_allocation": f"""WITH {SQL_EDGES}, s AS (SELECT {_strata('connection_type', a.CONNECTION_STRATA)} AS stratum, count(*) AS size, round(stddev_pop(confidence), 6) AS spread FROM edges GROUP BY 1),
      r AS (SELECT *, least({SAMPLED_TOTAL} * (size * spread) / sum(size * spread) OVER (), size::DOUBLE) AS r FROM s), f AS (SELECT *, floor(r) AS f FROM r),
      k AS (SELECT *, {SAMPLED_TOTAL} - sum(f) OVER () AS "left", row_number() OVER (ORDER BY size > f DESC, r - f DESC, stratum) AS rank FROM f),
      g AS (SELECT *, f + CASE WHEN rank <= "left" AND size > f THEN 1 ELSE 0 END AS g FROM k),
      o AS (SELECT *, {SAMPLED_TOTAL} - sum(g) OVER () AS owed, coalesce(sum(size - g) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
      SELECT stratum, size, CAST(g + greatest(0, least(size - g, owed - before)) AS BIGINT) AS allocated FROM o""",
    "audit_sample": f"WITH {SQL_EDGES} SELECT connection_type, row_number() OVER (PARTITION BY connection_type ORDER BY md5('1:' || connection_id), connection_id) AS position, connection_id FROM edges QUALIFY position <= {SAMPLE}",
    "audit_wrong_endpoints": f"""WITH {SQL_EDGES}, n AS (SELECT repo, file, content FROM source_files WHERE file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, file ORDER BY scanned_at DESC NULLS LAST, file_id DESC) = 1)
      SELECT e.connection_id FROM edges e JOIN n USING (repo, file) WHERE e.symbol <> '' AND NOT contains(coalesce(n.content, ''), e.symbol)""",
    "audit_missing_files": f"""WITH {SQL_NODES}, p AS (SELECT DISTINCT repo, {sql_clean_path('file')} AS path FROM source_files WHERE file IS NOT NULL), n AS (SELECT component_id, repo, {sql_clean_path('file')} AS path FROM nodes WHERE file <> '')
      SELECT component_id, path FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.repo = n.repo AND p.path = n.path)""",
    "audit_collisions": """SELECT from_id, to_id, connection_type, file, line, count(*) - 1 AS extra, min(seq) AS first FROM connections
      WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND connection_type IS NOT NULL AND file IS NOT NULL AND line IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "error_drift": """WITH RECURSIVE s AS (SELECT CAST(ts AS DATE) AS day, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 9) AS x, row_number() OVER (ORDER BY CAST(ts AS DATE)) AS n FROM events GROUP BY 1),
      w AS (SELECT avg(x) AS m, avg(x * x) - avg(x) * avg(x) AS v FROM s WHERE n <= 5),
      c AS (SELECT day, n, 0.0::DOUBLE AS z FROM s WHERE n = 1 UNION ALL SELECT s.day, s.n, CASE WHEN s.n <= 5 THEN 0.0 ELSE 0.2::DOUBLE * (s.x - w.m) + 0.8::DOUBLE * c.z END FROM c JOIN s ON s.n = c.n + 1, w),
      l AS (SELECT c.*, CASE WHEN n > 5 THEN 2.7::DOUBLE * sqrt(greatest(w.v, 1e-12::DOUBLE)) * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * (n - 5)))) ELSE 0.0 END AS lim FROM c, w)
      SELECT 'all' AS stratum, day, n, round(z, 9) AS z, round(lim, 9) AS "limit", n > 5 AND abs(z) > lim AS breach FROM l""",
    "llm_use_cases": f"""{SQL_GRAPH}, c AS (SELECT e.repo, e.file, e.symbol, e.to_id, n.name AS provider, min(e.seq) AS seq, bool_or(e.connection_type <> 'imports') AS called FROM edges e JOIN nodes n ON n.component_id = e.to_id
        WHERE n.component_type = 'llm' AND e.file IS NOT NULL AND coalesce(e.classification, '') NOT IN ({_list(s.UNUSED_CLASSES)}) GROUP BY ALL),
      k AS (SELECT *, CASE WHEN length(symbol) >= 3 AND symbol NOT IN ({_list(s.PLAIN_SYMBOLS)}) AND lower(symbol) NOT IN ({_list(s.PROVIDER_SYMBOLS)}) AND NOT regexp_matches(symbol, '^anonymous_\\d+$|^(\\./|/|\\.\\.)') THEN {_purpose('symbol', 'file')} END AS told
        FROM c WHERE (repo, file, to_id) IN (SELECT (repo, file, to_id) FROM c WHERE called)),
      f AS (SELECT repo, file, count(*) AS call_sites, count(DISTINCT to_id) AS providers, arg_min(provider, {{'o': lower(provider) IN ({_list(s.OBSERVERS)}), 'p': provider}}) AS main_provider, arg_min(told, seq) FILTER (told IS NOT NULL) AS by_symbol FROM k GROUP BY ALL),
      q AS (SELECT repo, file, arg_min(category, seq) AS by_prompt FROM (SELECT repo, unnest(list_append(coalesce(used_by, []), file)) AS file, seq, category FROM prompts WHERE category IS NOT NULL AND category <> 'unknown') GROUP BY ALL)
      SELECT f.repo, f.file, call_sites, providers, main_provider, coalesce(by_prompt, by_symbol, {_purpose("''", 'f.file')}) AS purpose, CASE WHEN by_prompt IS NOT NULL THEN 'prompt' WHEN by_symbol IS NOT NULL THEN 'function' ELSE 'file' END AS grouped_by
      FROM f LEFT JOIN q ON q.repo = f.repo AND q.file = f.file""",
    "shared_dependencies": f"""WITH {SQL_NODES}, p AS (SELECT coalesce(stable_id, concat_ws('|', lower(name), component_type)) AS dependency, repo, arg_min(coalesce(version, ''), seq) AS version FROM nodes WHERE layer = 'external' GROUP BY 1, 2)
      SELECT dependency, count(*) AS repos, count(DISTINCT version) AS versions, count(DISTINCT version) > 1 AS version_skew FROM p GROUP BY 1 HAVING count(*) >= 2""",
    "cross_repo_services": f"""{SQL_GRAPH}, m AS (SELECT lower(name) AS service, repo, component_id FROM nodes WHERE component_type = 'service' AND name IS NOT NULL),
      c AS (SELECT DISTINCT e.repo AS from_repo, e.from_id, e.connection_type, lower(n.name) AS service FROM edges e JOIN nodes n ON n.component_id = e.to_id WHERE e.connection_type IN ('service-call', 'runtime-binding'))
      SELECT from_repo, from_id, connection_type, c.service, count(DISTINCT m.repo) AS other_repos FROM c JOIN m ON m.service = c.service AND m.repo IS DISTINCT FROM c.from_repo GROUP BY ALL""",
    "cross_repo_service_members": f"WITH {SQL_NODES} SELECT lower(name) AS service, repo, component_id FROM nodes WHERE component_type = 'service' AND name IS NOT NULL",
    "portfolio_status": f"""{SQL_GRAPH}, n AS (SELECT repo, count(*) AS c FROM nodes GROUP BY 1), e AS (SELECT repo, count(*) AS x, max(detected_at) AS last FROM edges GROUP BY 1)
      SELECT count(*) AS repos, sum(c) AS components, sum(x) AS connections, count(*) FILTER (last < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS stale_repos FROM n FULL JOIN e USING (repo)""",
    "prompt_summary": f"""WITH p AS (SELECT * FROM prompts WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY arrived_at DESC NULLS LAST, seq DESC) = 1)
      SELECT provider, {_category('content')} AS detected, count(*) AS prompts, count(*) FILTER (len(coalesce(variables, [])) > 0) AS templated, round(avg(token_count), 4) AS mean_tokens FROM p GROUP BY 1, 2""",
    "prompt_variables": r"""SELECT DISTINCT seq, v AS variable FROM (SELECT seq, unnest(regexp_extract_all(content, '\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}|\$\{([A-Za-z_][A-Za-z0-9_]*)\}|\{([A-Za-z_][A-Za-z0-9_]*)\}', 1)
        || regexp_extract_all(content, '\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}|\$\{([A-Za-z_][A-Za-z0-9_]*)\}|\{([A-Za-z_][A-Za-z0-9_]*)\}', 2) || regexp_extract_all(content, '\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}|\$\{([A-Za-z_][A-Za-z0-9_]*)\}|\{([A-Za-z_][A-Za-z0-9_]*)\}', 3)) AS v FROM prompts WHERE content IS NOT NULL) WHERE v <> ''""",
    "user_memory": """SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS value, min(ts) AS first_seen, max(ts) AS last_seen,
      arg_max(value, {'t': ts, 'i': event_id}) FILTER (value IS NOT NULL) AS latest_value FROM events GROUP BY 1""",
    "last_events": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position, event_id, event_type FROM events QUALIFY position <= 40",
    "journal_health": """WITH g AS (SELECT count(*) AS records, count(*) FILTER (event_type = 'error') AS errors, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE AS d, count(*) FILTER (event_type = 'signup') AS registers FROM events)
      SELECT records, errors, round(coalesce(d, 0), 6) AS window_days, registers, round(CASE WHEN d >= 1 THEN registers / d ELSE 0 END, 6) AS per_day FROM g""",
    "user_sessions": """WITH l AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
      s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, s""",
    "daily_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
}
