"""Extraction over whole files, snippets and documents, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as x, model_calls, services
from ..operators.graph_views import sql_clean_path, sql_trimmed
from ..session import table

SCHEDULES = [*x.SCHEDULES, "15 3 * * *", "*/7 3 * * *", "*/20 * * * 1", "0 */6 * * 1", "0 9 1 1 *", "@daily"]


def _files(spark, d):
    return x.newest_files(table(spark, d, "source_files"))


def _code(spark, d):
    return table(spark, d, "connections")


def import_statements(spark, d):
    return x.imports(_files(spark, d)).select("file_id", "line", "kind", "target")


def imported_packages(spark, d):
    got = x.imports(_files(spark, d)).withColumn("package", x.package_of(F.col("target"))).where("package is not null")
    return got.groupBy("package").agg(F.count(F.lit(1)).alias("imports"), F.countDistinct("file_id").alias("files"))


def resolved_imports(spark, d):
    f = _files(spark, d)
    return x.resolve_imports(x.imports(f), f)


def module_names(spark, d):
    return _files(spark, d).select("file_id", x.module_name(F.col("file")).alias("module"), x.module_layer(F.col("file")).alias("layer"))


def model_call_sites(spark, d):
    return model_calls.call_sites(_code(spark, d), "seq", "code")


def traced_model_calls(spark, d):
    """No SQL: imports, clients and arguments of whole files; tested on small files."""
    return model_calls.traced_calls(_files(spark, d))


def orm_calls(spark, d):
    return x.orm_calls(_code(spark, d), "seq", "code")


def env_references(spark, d):
    return x.env_references(_code(spark, d), "code")


def connection_addresses(spark, d):
    return x.addresses(_code(spark, d), "seq", "code")


def queue_roles(spark, d):
    return x.queue_roles(_code(spark, d), "seq", "code")


def service_calls(spark, d):
    return services.service_calls(_files(spark, d))


def snippet_services(spark, d):
    """The same over the snippets of connections; a snippet seldom holds the import."""
    return services.service_calls(_code(spark, d).select("seq", "file", F.col("code").alias("content")), "seq")


def declared_symbols(spark, d):
    return x.declarations(_files(spark, d))


def type_conformances(spark, d):
    return x.conformances(_files(spark, d))


def view_navigation(spark, d):
    return x.view_navigation(_code(spark, d), "seq", "code")


def field_usage(spark, d):
    return x.interface_fields(_files(spark, d))


def document_links(spark, d):
    return x.document_links(table(spark, d, "documents"))


def document_relations(spark, d):
    return x.document_relations(table(spark, d, "documents"))


def resolved_relations(spark, d):
    """Relations with the one document that declares the target; unresolved and ambiguous ones have none."""
    docs = table(spark, d, "documents")
    rel, ids = x.document_relations(docs), x.document_identities(docs)
    return rel.join(ids, F.lower("target") == F.col("identity"), "left").select("doc_id", "field", "target", F.col("document").alias("to_doc"), F.coalesce(F.col("documents") > 1, F.lit(False)).alias("ambiguous"))


def schedule_words(spark, d):
    rows = spark.createDataFrame([(s,) for s in SCHEDULES], "schedule string")
    return rows.select("schedule", x.describe_schedule(F.col("schedule")).alias("description"))


def infrastructure(spark, d):
    return x.infrastructure(table(spark, d, "source_files"))


QUERIES = {
    f.__name__: f
    for f in (
        import_statements, imported_packages, resolved_imports, module_names, orm_calls, env_references, connection_addresses, queue_roles, service_calls, snippet_services, model_call_sites, traced_model_calls, declared_symbols, type_conformances,
        view_navigation, field_usage, document_links, document_relations, resolved_relations, schedule_words, infrastructure,
    )
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _first(text: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_q(p)}) THEN {{'kind': '{k}', 'value': regexp_extract({text}, {_q(p)}, 1)}}" for k, p in patterns) + " END"


_FILES = "WITH files AS (SELECT repo, file, file_id, code_lang, content FROM source_files WHERE file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, file ORDER BY scanned_at DESC NULLS LAST, file_id DESC) = 1)"
_LINES = _FILES + r", split AS (SELECT *, regexp_split_to_array(content, '\r?\n') AS ls FROM files WHERE content IS NOT NULL), lines AS (SELECT repo, file, file_id, code_lang, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM split)"
_IMPORTS = _LINES + f", found AS (SELECT *, {_first('text', x.IMPORTS)} AS i FROM lines), imports AS (SELECT repo, file, file_id, line, i.kind AS kind, i.value AS target FROM found WHERE i IS NOT NULL)"
_FOLD = "regexp_replace({0}, '(^|/)[^/.][^/]*/\\.\\./', '\\1', 'g')"
_JOINED = f"CASE WHEN target LIKE '@/%' THEN 'src/' || substr(target, 3) ELSE regexp_replace({sql_clean_path('file')}, '[^/]*$', '') || regexp_replace(target, '^\\./', '') END"
for _ in range(4):
    _JOINED = _FOLD.format(_JOINED)
_IN = lambda v: ", ".join(f"'{y}'" for y in v)
_ENV = " || ".join(f"regexp_extract_all(code, {_q(p)}, 1)" for p in x.ENV_REFERENCES)
_ENVCAT = "CASE " + " ".join(f"WHEN regexp_matches(upper(name), '{p}')" + (" AND NOT contains(upper(name), 'VERCEL')" if c == "api-key" else "") + f" THEN '{c}'" for c, p in x.ENV_CATEGORIES) + " ELSE 'other' END"
_PRODUCE, _CONSUME = r"([A-Za-z_][A-Za-z0-9_]*)Queue\.add\(\s*['\"`]([^'\"`]+)['\"`]", r"new Worker\(\s*['\"`]([^'\"`]+)['\"`]\s*,\s*([A-Za-z_][A-Za-z0-9_]*)"
_CONF = r"^\s*(?:public\s+|final\s+|export\s+|default\s+|abstract\s+)*(?:struct|class|enum|actor|extension)\s+([A-Za-z0-9_]+)(?:<[^>]*>)?\s*(?::|extends|\()\s*([A-Za-z0-9_., ]+)"
_VIEW = r"(?:destination:|sheet\s*\{|fullScreenCover\s*\{|present\()\s*([A-Z][A-Za-z0-9_]*)\("


def _service(key: str, name: str, kind: str, patterns, proof) -> str:
    """One service over the lines with a hit of any; m is the file's modifier, content the file's whole text."""
    mine = services.either(patterns)
    before = f"regexp_extract(text, {_q('^(.*?)(?:' + mine + ')')}, 1)"
    imported = f"regexp_matches(content, {_q(services.either(proof))})" if proof else "false"
    conf = f"0.9::DOUBLE - CASE WHEN regexp_matches(regexp_replace({before}, {_q(services.CLOSED_STRINGS)}, '', 'g'), {_q(chr(91) + chr(34) + chr(39) + chr(93))}) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + m - CASE WHEN {imported} THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END"
    return f"SELECT {key}, line, '{name}' AS service, '{kind}' AS component_type, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {conf})), 2) AS confidence FROM called WHERE regexp_matches(text, {_q(mine)}) AND NOT contains({before}, '//')"


def _services_sql(given: str, key: str) -> str:
    every = _q(services.either(p for _, _, patterns, _ in services.SERVICES for p in patterns))
    by_file = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(file, ''), {_q(p)}) THEN {v}::DOUBLE" for p, v in services.FILE_MODIFIERS) + " ELSE 0.0::DOUBLE END"
    return f"""{given}, split AS (SELECT {key}, content, {by_file} AS m, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, unnest(string_split(content, chr(10))) AS text FROM files
        WHERE regexp_matches(content, {every}) AND regexp_matches(coalesce(file, ''), {_q(services.SCANNED_FILES)}) AND NOT regexp_matches(coalesce(file, ''), {_q(services.EXCLUDED_FILES)})),
      called AS (SELECT * FROM split WHERE regexp_matches(text, {every}) AND NOT (starts_with(ltrim(text), '//') OR starts_with(ltrim(text), '#') OR starts_with(ltrim(text), '*') OR regexp_matches(text, {_q(services.either(services.EXAMPLES))}))),
      hits AS ({" UNION ALL ".join(_service(key, *s) for s in services.SERVICES)}) SELECT * FROM hits WHERE confidence >= {services.MIN_CONFIDENCE}"""


_WIKI = lambda v: "regexp_replace(regexp_replace(" + sql_trimmed(f"regexp_extract({v}, '^([^|#]*)', 1)") + ", '^\\./', ''), '(?i)\\.md$', '')"
_MD = lambda v: f"CASE WHEN regexp_matches({sql_trimmed(v)}, '^(#|//|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL ELSE " + sql_trimmed(f"regexp_extract({sql_trimmed(v)}, '^<?([^#?>\\s]*)', 1)") + " END"
_UNQUOTED = "regexp_replace(" + sql_trimmed("v") + ", '^[\"\'\']|[\"\'\']$', '', 'g')"
_RELATIONS = f"""r AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_extract(text, '^---\\r?\\n([\\s\\S]*?)\\r?\\n---', 1), '\\r?\\n')) AS l FROM documents WHERE regexp_extract(text, '^---\\r?\\n([\\s\\S]*?)\\r?\\n---', 1) <> ''),
  f AS (SELECT doc_id, lower(regexp_extract(l, '^([A-Za-z_][A-Za-z0-9_-]*):\\s*(.*)$', 1)) AS field, regexp_extract(l, '^([A-Za-z_][A-Za-z0-9_-]*):\\s*(.*)$', 2) AS v FROM r),
  v AS (SELECT doc_id, field, unnest(string_split(regexp_replace({sql_trimmed('v')}, '^\\[|\\]$', '', 'g'), ',')) AS v FROM f WHERE field IN ({_IN(x.RELATIONS)})),
  relations AS (SELECT DISTINCT doc_id, field, {_WIKI(_UNQUOTED)} AS target FROM v WHERE {_WIKI(_UNQUOTED)} <> '')"""

SQL = {
    "import_statements": _IMPORTS + " SELECT file_id, line, kind, target FROM imports",
    "imported_packages": _IMPORTS
    + ", p AS (SELECT file_id, nullif(regexp_extract(target, '^(@[^/]+/[^/]+|[^/:.]+)', 1), '') AS package FROM imports WHERE NOT regexp_matches(target, '^(\\.|/|@/|~/)')) SELECT package, count(*) AS imports, count(DISTINCT file_id) AS files FROM p WHERE package IS NOT NULL GROUP BY 1",
    "resolved_imports": _IMPORTS
    + f""", j AS (SELECT *, {_JOINED} AS j FROM imports WHERE regexp_matches(target, '^(\\./|\\.\\./|@/)')), b AS (SELECT *, regexp_replace(j, '\\.(js|jsx)$', '') AS b FROM j),
      c AS (SELECT file_id, line, target, repo, unnest([1, 2, 3, 4, 5, 6, 7]) AS at, unnest([j, b || '.ts', b || '.tsx', b || '.js', b || '.jsx', b || '/index.ts', b || '/index.js']) AS path FROM b),
      t AS (SELECT DISTINCT repo, {sql_clean_path('file')} AS path FROM files)
      SELECT c.file_id, c.line, c.target, arg_min(c.path, c.at) FILTER (t.path IS NOT NULL) AS to_file FROM c LEFT JOIN t ON t.repo = c.repo AND t.path = c.path GROUP BY 1, 2, 3""",
    "module_names": _FILES
    + r""" SELECT file_id, regexp_replace(regexp_replace(regexp_replace(replace(file, '\', '/'), '\.[^./]+$', ''), '^/?(src|app|lib)/(.)', '\2'), '(.)/index$', '\1') AS module,
      CASE WHEN regexp_matches(lower(replace(file, '\', '/')), '(^|/)(ui|components|views|pages|frontend|web)(/|$)') THEN 'frontend' WHEN regexp_matches(lower(replace(file, '\', '/')), '(^|/)(db|database|prisma|drizzle|migrations)(/|$)') THEN 'database'
        WHEN regexp_matches(lower(replace(file, '\', '/')), '(^|/)(queue|queues|jobs|workers)(/|$)') THEN 'queue' WHEN regexp_matches(lower(replace(file, '\', '/')), '(^|/)(infra|infrastructure|terraform|k8s|docker)(/|$)') THEN 'infra' ELSE 'backend' END AS layer FROM files""",
    "orm_calls": f"""WITH c AS (SELECT repo, file, seq, unnest(regexp_extract_all(code, {_q(x.ORM_CALL)}, 1)) AS model, unnest(regexp_extract_all(code, {_q(x.ORM_CALL)}, 2)) AS op FROM connections WHERE code IS NOT NULL),
      g AS (SELECT repo, file, lower(model) AS model, count(*) FILTER (op IN ({_IN(x.ORM_READS)})) AS reads, count(*) FILTER (op IN ({_IN(x.ORM_WRITES)})) AS writes, min(seq) AS first_row FROM c WHERE op IN ({_IN(x.ORM_READS + x.ORM_WRITES)}) GROUP BY ALL)
      SELECT *, CASE WHEN reads > 0 AND writes > 0 THEN 'reads+writes' WHEN writes > 0 THEN 'writes' ELSE 'reads' END AS label FROM g""",
    "env_references": f"WITH r AS (SELECT unnest(list_distinct({_ENV})) AS name FROM connections WHERE code IS NOT NULL) SELECT name, {_ENVCAT} AS category, count(*) AS rows FROM r GROUP BY name",
    "connection_addresses": f"""WITH a AS (SELECT seq, regexp_extract(code, {_q(x.ADDRESS)}, 1) AS protocol, lower(regexp_extract(code, {_q(x.ADDRESS)}, 2)) AS host, CAST(nullif(regexp_extract(code, {_q(x.ADDRESS)}, 3), '') AS INTEGER) AS port, nullif(nullif(regexp_extract(code, {_q(x.ADDRESS)}, 4), ''), '/') AS p FROM connections WHERE regexp_matches(code, {_q(x.ADDRESS)}))
      SELECT seq, protocol, host, port, CASE WHEN protocol NOT IN ('http', 'https') THEN regexp_replace(p, '^/', '') END AS database, CASE WHEN protocol IN ('http', 'https') THEN p END AS path,
        CASE {' '.join(f"WHEN protocol IN ({_IN(v)}) THEN '{k}'" for k, v in x.RESOURCES.items())} END AS resource FROM a""",
    "queue_roles": f"""SELECT seq, 'producer' AS role, regexp_extract(code, {_q(_PRODUCE)}, 1) AS queue, regexp_extract(code, {_q(_PRODUCE)}, 2) AS job, CAST(NULL AS INTEGER) AS concurrency FROM connections WHERE regexp_matches(code, {_q(_PRODUCE)})
      UNION ALL SELECT seq, 'consumer', regexp_extract(code, {_q(_CONSUME)}, 1), regexp_extract(code, {_q(_CONSUME)}, 2), CAST(nullif(regexp_extract(code, 'concurrency:\\s*([0-9]+)', 1), '') AS INTEGER) FROM connections WHERE regexp_matches(code, {_q(_CONSUME)})""",
    "model_call_sites": f"""WITH l AS (SELECT seq, unnest(range(1, len(string_split(code, chr(10))) + 1)) AS line, unnest(string_split(code, chr(10))) AS text FROM connections WHERE code IS NOT NULL), s AS (SELECT seq, line, CASE {" ".join(f"WHEN regexp_matches(text, {_q(services.either(p))}) THEN '{n}:{v}'" for n, v, p in model_calls.CALL_SITES)} END AS s FROM l)
      SELECT seq, line, split_part(s, ':', 1) AS name, split_part(s, ':', 2) AS provider FROM s WHERE s IS NOT NULL""",
    "service_calls": _services_sql(_FILES, "file_id"),
    "snippet_services": _services_sql("WITH files AS (SELECT seq, file, code AS content FROM connections)", "seq"),
    "declared_symbols": _LINES + ", d AS (SELECT file_id, line, CASE " + " ".join(f"WHEN code_lang = '{lang}' THEN {_first('text', p)}" for lang, p in x.DECLARATIONS.items()) + " END AS d FROM lines) SELECT file_id, line, d.kind AS kind, d.value AS name FROM d WHERE d IS NOT NULL",
    "type_conformances": _LINES + f", c AS (SELECT file_id, regexp_extract(text, {_q(_CONF)}, 1) AS name, unnest(regexp_split_to_array(regexp_extract(text, {_q(_CONF)}, 2), '\\s*,\\s*')) AS base FROM lines WHERE regexp_matches(text, {_q(_CONF)})) SELECT DISTINCT file_id, name, trim(base) AS base FROM c WHERE trim(base) <> ''",
    "view_navigation": f"SELECT seq, unnest(list_distinct(regexp_extract_all(code, {_q(_VIEW)}, 1))) AS view FROM connections WHERE code IS NOT NULL",
    "field_usage": _LINES
    + r""", o AS (SELECT *, CASE WHEN regexp_matches(text, '^\s*(?:export\s+)?interface\s+[A-Za-z0-9_]+.*\{\s*$') THEN 1 WHEN regexp_matches(text, '^\s*\}') THEN 0 END AS opened FROM lines WHERE code_lang = 'typescript'),
      i AS (SELECT *, coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside, regexp_extract(text, '^\s*(?:readonly\s+)?([A-Za-z_][A-Za-z0-9_]*)\??\s*:', 1) AS field FROM o),
      d AS (SELECT repo, field, count(*) AS declared FROM i WHERE inside = 1 AND field <> '' GROUP BY 1, 2),
      u AS (SELECT repo, field, count(*) AS used FROM (SELECT repo, unnest(regexp_extract_all(content, '\.([A-Za-z_][A-Za-z0-9_]*)', 1)) AS field FROM files WHERE content IS NOT NULL) GROUP BY 1, 2)
      SELECT d.repo, d.field, declared, coalesce(used, 0) AS used, CASE WHEN coalesce(used, 0) > 0 THEN 'used' ELSE 'unused' END AS usage FROM d LEFT JOIN u ON u.repo = d.repo AND u.field = d.field""",
    "document_links": f"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents WHERE text IS NOT NULL),
      b AS (SELECT doc_id, ls, CASE WHEN {sql_trimmed('ls[1]')} = '---' AND list_position(list_transform(ls[2:], lambda v: {sql_trimmed('v')}), '---') > 0 THEN list_position(list_transform(ls[2:], lambda v: {sql_trimmed('v')}), '---') + 1 ELSE 0 END AS b FROM s),
      l AS (SELECT doc_id, b, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM b), k AS (SELECT *, CASE WHEN regexp_matches(text, '^\\s*(```|~~~)') THEN 1 ELSE 0 END AS f FROM l WHERE line > b),
      o AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY line) % 2 AS depth FROM k), p AS (SELECT doc_id, line, regexp_replace(text, '`[^`]*`', '', 'g') AS text FROM o WHERE f = 0 AND depth = 0),
      h AS (SELECT doc_id, line, 'wikilink' AS type, unnest(list_transform(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1), lambda v: {_WIKI('v')})) AS target FROM p
        UNION ALL SELECT doc_id, line, 'markdown-link', unnest(list_transform(regexp_extract_all(text, '(?:^|[^!])\\[[^\\]]*\\]\\(([^)]+)\\)', 1), lambda v: {_MD('v')})) FROM p)
      SELECT DISTINCT * FROM h WHERE target IS NOT NULL AND target <> ''""",
    "document_relations": f"WITH {_RELATIONS} SELECT * FROM relations",
    "resolved_relations": f"""WITH {_RELATIONS}, i AS (SELECT lower(regexp_extract(text, '^---\\r?\\n(?:[\\s\\S]*?\\r?\\n)?id:[ \\t]*([^\\r\\n]+?)[ \\t]*\\r?\\n', 1)) AS identity, count(*) AS n, min(doc_id) AS d FROM documents GROUP BY 1)
      SELECT r.doc_id, r.field, r.target, CASE WHEN i.n = 1 THEN i.d END AS to_doc, coalesce(i.n > 1, false) AS ambiguous FROM relations r LEFT JOIN i ON i.identity = lower(r.target) AND i.identity <> ''""",
    "schedule_words": "WITH s AS (SELECT unnest([" + ", ".join(_q(v) for v in SCHEDULES) + r"]) AS schedule), p AS (SELECT schedule, regexp_split_to_array(trim(schedule), '\s+') AS p FROM s) SELECT schedule, CASE " + " ".join(f"WHEN schedule = {_q(k)} THEN {_q(v)}" for k, v in x.SCHEDULES.items())
    + " WHEN len(p) >= 5 AND p[1] <> '*' AND p[2] <> '*' AND p[3] = '*' AND p[4] = '*' AND p[5] = '*' THEN 'Daily at ' || CASE WHEN length(p[2]) < 2 THEN lpad(p[2], 2, '0') ELSE p[2] END || ':' || CASE WHEN length(p[1]) < 2 THEN lpad(p[1], 2, '0') ELSE p[1] END"
    + " WHEN len(p) >= 5 AND starts_with(p[1], '*/') THEN 'Every ' || substr(p[1], 3) || ' minutes' WHEN len(p) >= 5 AND starts_with(p[2], '*/') THEN 'Every ' || substr(p[2], 3) || ' hours' ELSE schedule END AS description FROM p",
    "infrastructure": "WITH p AS (SELECT DISTINCT repo, " + sql_clean_path("file") + " AS path FROM source_files WHERE file IS NOT NULL), k AS (" + " UNION ALL ".join(f"SELECT repo, path, '{k}' AS infrastructure FROM p WHERE regexp_matches(path, {_q(v)})" for k, v in x.INFRASTRUCTURE) + ") SELECT repo, infrastructure, count(*) AS files FROM k GROUP BY 1, 2",
}
