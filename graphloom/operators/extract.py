"""Text extraction: files, documents and snippets to lines, imports, calls, references, links and declarations.

Patterns use explicit classes instead of word boundaries, so that the JVM's and other engines' regular expressions agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import spread
from .graph_views import clean_path, trimmed

#: Import statements by kind, in order of precedence; group 1 is the target.
IMPORTS = (
    ("from", r"^\s*(?:import|export)\s[^'\"]*from\s+['\"]([^'\"]+)['\"]"),
    ("side-effect", r"^\s*import\s+['\"]([^'\"]+)['\"]"),
    ("require", r"(?:^|[^A-Za-z0-9_])require\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    ("dynamic", r"(?:^|[^A-Za-z0-9_])import\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    ("python-from", r"^\s*from\s+([A-Za-z0-9_.]+)\s+import"),
    ("use", r"^\s*(?:pub\s+)?use\s+([A-Za-z0-9_:]+)"),
    ("module", r"^\s*import\s+([A-Za-z0-9_.]+)\s*$"),
)
#: Client operations of an object mapper that read and that write.
ORM_READS = ("findMany", "findUnique", "findFirst", "findUniqueOrThrow", "findFirstOrThrow", "count", "aggregate", "groupBy")
ORM_WRITES = ("create", "createMany", "update", "updateMany", "upsert", "delete", "deleteMany")
ORM_CALL = r"(?:^|[^A-Za-z0-9_])prisma\.([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z]+)\("
#: References to environment variables.
ENV_REFERENCES = (r"process\.env\.([A-Z_][A-Z0-9_]*)", r"process\.env\[['\"]([A-Z_][A-Z0-9_]*)['\"]\]", r"import\.meta\.env\.([A-Z_][A-Z0-9_]*)", r"os\.environ\[['\"]([A-Z_][A-Z0-9_]*)['\"]\]", r"os\.getenv\(['\"]([A-Z_][A-Z0-9_]*)['\"]")
#: Categories of variables by parts of names, in order.
ENV_CATEGORIES = (
    ("database", "DATABASE|DB_|POSTGRES|MYSQL|MONGO|REDIS|SUPABASE"),
    ("auth", "AUTH|JWT|SECRET|SESSION|NEXTAUTH|CLERK"),
    ("api-key", "API_KEY|APIKEY|_KEY|TOKEN"),
    ("service", "STRIPE|OPENAI|ANTHROPIC|SENDGRID|TWILIO|AWS_"),
    ("infra", "VERCEL|RAILWAY|PORT|HOST|NODE_ENV|NEXT_PUBLIC"),
    ("app-config", "APP_|SITE_|BASE_URL|PUBLIC_URL"),
)
#: Protocols of connection addresses and what they lead to.
RESOURCES = {"database": ("postgres", "postgresql", "mysql", "mongodb"), "cache": ("redis", "rediss"), "queue": ("amqp", "amqps"), "api": ("http", "https")}
ADDRESS = r"(?:^|[^A-Za-z0-9+.])(postgres|postgresql|mysql|mongodb|redis|rediss|amqp|amqps|http|https)://(?:[^/@\s\"'`]*@)?([A-Za-z0-9][A-Za-z0-9.-]*)(?::([0-9]{1,5}))?(/[A-Za-z0-9_./-]*)?"
#: Declarations of compiled languages.
DECLARATIONS = {
    "rust": (("fn", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?fn\s+([A-Za-z0-9_]+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+([A-Za-z0-9_]+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+([A-Za-z0-9_]+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+([A-Za-z0-9_]+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+([A-Za-z0-9_:]+)"), ("mod", r"^\s*(?:pub\s+)?mod\s+([A-Za-z0-9_]+)")),
    "swift": (("struct", r"^\s*(?:public\s+)?struct\s+([A-Za-z0-9_]+)"), ("class", r"^\s*(?:public\s+|final\s+)*class\s+([A-Za-z0-9_]+)"), ("actor", r"^\s*(?:public\s+)?actor\s+([A-Za-z0-9_]+)"), ("enum", r"^\s*(?:public\s+)?enum\s+([A-Za-z0-9_]+)"), ("protocol", r"^\s*(?:public\s+)?protocol\s+([A-Za-z0-9_]+)"), ("func", r"^\s*(?:[a-z]+\s+)*func\s+([A-Za-z0-9_]+)")),
    "python": (("class", r"^\s*class\s+([A-Za-z0-9_]+)"), ("def", r"^\s*(?:async\s+)?def\s+([A-Za-z0-9_]+)")),
    "typescript": (("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z0-9_]+)"), ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z0-9_]+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z0-9_]+)")),
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
#: Typed relations of document headers, and files that tell of infrastructure.
RELATIONS = ("supports", "contradicts", "supersedes", "superseded_by", "depends_on", "extends", "related", "tested_by")
INFRASTRUCTURE = (("railway", r"(^|/)railway\.(toml|json)$"), ("vercel", r"(^|/)vercel\.json$"), ("docker", r"(^|/)(Dockerfile|docker-compose\.ya?ml)$"), ("kubernetes", r"(^|/)(k8s|kubernetes|helm)/"), ("workflows", r"(^|/)\.github/workflows/"), ("terraform", r"(^|/)(main|terraform)\.tf$"), ("swift-package", r"(^|/)Package\.swift$"), ("procfile", r"(^|/)Procfile$"), ("jobs", r"(^|/)jobs/"), ("queue", r"(^|/)queue/"))
#: Descriptions of schedules.
SCHEDULES = {"* * * * *": "Every minute", "*/5 * * * *": "Every 5 minutes", "*/10 * * * *": "Every 10 minutes", "*/15 * * * *": "Every 15 minutes", "*/30 * * * *": "Every 30 minutes", "0 * * * *": "Every hour", "0 0 * * *": "Daily at midnight", "0 0 * * 0": "Weekly on Sunday", "0 0 1 * *": "Monthly on the 1st"}


def newest_files(source_files: DataFrame) -> DataFrame:
    """The newest scan of each file: repo, file, file_id, code_lang, content. Rows without file are left out."""
    row = F.struct("file_id", "code_lang", "content")
    return source_files.where("file is not null").groupBy("repo", "file").agg(F.max_by(row, F.struct("scanned_at", "file_id")).alias("r")).select("repo", "file", "r.*")


def lines_of(rows: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """One row per line, numbered from 1; a null text has no lines."""
    return rows.where(F.col(text).isNotNull()).select(key, *keep, F.posexplode(F.split(text, r"\r?\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def first_pattern(text: Column, patterns) -> Column:
    """struct(kind, value) of the first pattern that matches; null if none does."""
    out = None
    for kind, pattern in patterns:
        v = F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, pattern, 1).alias("value"))
        cond = text.rlike(pattern)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


#: Where a line holds several statements, one may also begin after a semicolon or a closing brace.
STATEMENTS = tuple((k, p.replace(r"^\s*", r"(?:^|[;}])\s*", 1).replace(r"\s*$", r"\s*(?:$|(?=;))", 1).replace(r"[^'\"]*from", r"[^'\";]*from", 1)) for k, p in IMPORTS)


def imports(files: DataFrame) -> DataFrame:
    """Import statements, all of a line and a repeated one each time: file_id, repo, file, line, kind, target."""
    lines = lines_of(files, "file_id", "content", "repo", "file").select("file_id", "repo", "file", "line", "content")
    hits = lambda kind, p: F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("target")))
    found = lines.select("file_id", "repo", "file", "line", F.explode(F.concat(*[hits(k, p) for k, p in STATEMENTS])).alias("i"))
    return found.select("file_id", "repo", "file", "line", "i.kind", "i.target")


def package_of(target: Column) -> Column:
    """Package of a bare import (scope kept, subpath cut); null for relative, aliased and absolute targets."""
    return F.when(~target.rlike(r"^(\.|/|@/|~/)"), F.nullif(F.regexp_extract(target, r"^(@[^/]+/[^/]+|[^/:.]+)", 1), F.lit("")))


def folded(path: Column) -> Column:
    """A path with each .. taken off together with the folder before it; those that lead above the root stay."""
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(".."))
    step = lambda done, s: F.when((s == "..") & (last(done) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """Relative and aliased targets with the file they lead to: file_id, line, target, to_file (null if none).

    Candidates in order: the path itself, then with each extension (js may mean ts), then an index file. ``@/`` is src/.
    """
    rel = found.where(F.col("target").rlike(r"^(\./|\.\./|@/)"))
    folder = F.regexp_replace(clean_path(F.col("file")), r"[^/]*$", "")
    joined = F.when(F.startswith("target", F.lit("@/")), F.concat(F.lit("src/"), F.expr("substr(target, 3)"))).otherwise(F.concat(folder, F.regexp_replace("target", r"^\./", "")))
    joined = folded(joined)
    bare = F.regexp_replace(joined, r"\.(js|jsx)$", "")
    ends = [joined, *[F.concat(bare, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")]]
    cand = rel.select("file_id", "line", "target", "repo", F.posexplode(F.array_distinct(F.array(*ends))).alias("at", "path"))
    there = files.select("repo", clean_path(F.col("file")).alias("path")).distinct().withColumn("hit", F.lit(True))
    hits = cand.join(there, ["repo", "path"], "left")
    return hits.groupBy("file_id", "line", "target").agg(F.min_by("path", F.when(F.col("hit"), F.col("at"))).alias("to_file"))


def module_name(file: Column) -> Column:
    """Component name of a file: no extension, no leading src, app or lib, no trailing index."""
    path = F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), r"\.[^./]+$", "")
    return F.regexp_replace(F.regexp_replace(path, r"^/?(src|app|lib)/(.)", "$2"), r"(.)/index$", "$1")


def module_layer(file: Column) -> Column:
    low = F.lower(F.replace(file, F.lit("\\"), F.lit("/")))
    return (
        F.when(low.rlike(r"(^|/)(ui|components|views|pages|frontend|web)(/|$)"), "frontend")
        .when(low.rlike(r"(^|/)(db|database|prisma|drizzle|migrations)(/|$)"), "database")
        .when(low.rlike(r"(^|/)(queue|queues|jobs|workers)(/|$)"), "queue")
        .when(low.rlike(r"(^|/)(infra|infrastructure|terraform|k8s|docker)(/|$)"), "infra")
        .otherwise("backend")
    )


def orm_calls(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Mapped models per file: repo, file, model, reads, writes, first_row, label. ``rows`` has repo and file."""
    pairs = F.arrays_zip(F.regexp_extract_all(code, F.lit(ORM_CALL), F.lit(1)).alias("model"), F.regexp_extract_all(code, F.lit(ORM_CALL), F.lit(2)).alias("op"))
    calls = rows.where(F.col(code).isNotNull()).select("repo", "file", key, F.explode(pairs).alias("c")).select("repo", "file", key, F.lower("c.model").alias("model"), F.col("c.op").alias("op"))
    known = calls.where(F.col("op").isin(*ORM_READS, *ORM_WRITES))
    g = known.groupBy("repo", "file", "model").agg(F.count_if(F.col("op").isin(*ORM_READS)).alias("reads"), F.count_if(F.col("op").isin(*ORM_WRITES)).alias("writes"), F.min(key).alias("first_row"))
    label = F.when((F.col("reads") > 0) & (F.col("writes") > 0), "reads+writes").when(F.col("writes") > 0, "writes").otherwise("reads")
    return g.withColumn("label", label)


def env_references(rows: DataFrame, code: str) -> DataFrame:
    """Environment variables by number of references: name, category, rows."""
    names = F.array_distinct(F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in ENV_REFERENCES]))
    refs = rows.where(F.col(code).isNotNull()).select(F.explode(names).alias("name"))
    return refs.groupBy("name").agg(F.count(F.lit(1)).alias("rows")).select("name", env_category(F.col("name")).alias("category"), "rows")


def env_category(name: Column) -> Column:
    up = F.upper(name)
    out = None
    for category, pattern in ENV_CATEGORIES:
        cond = up.rlike(pattern)
        if category == "api-key":
            cond &= ~F.contains(up, F.lit("VERCEL"))
        out = F.when(cond, category) if out is None else out.when(cond, category)
    return out.otherwise("other")


def addresses(rows: DataFrame, key: str, code: str) -> DataFrame:
    """The connection addresses of each text: key, protocol, host, port, database, path, resource. Userinfo is not kept."""
    part = lambda i: F.nullif(F.regexp_extract("a", ADDRESS, i), F.lit(""))
    got = rows.where(F.col(code).rlike(ADDRESS)).select(key, F.explode(F.regexp_extract_all(code, F.lit(ADDRESS), F.lit(0))).alias("a")).select(key, part(1).alias("protocol"), F.lower(part(2)).alias("host"), part(3).cast("int").alias("port"), part(4).alias("p"))
    web, p = F.col("protocol").isin("http", "https"), F.when(F.col("p") != "/", F.col("p"))
    resource = F.lit(None).cast("string")
    for name, protocols in RESOURCES.items():
        resource = F.when(F.col("protocol").isin(*protocols), name).otherwise(resource)
    return got.select(key, "protocol", "host", "port", F.when(~web, F.regexp_replace(p, "^/", "")).alias("database"), F.when(web, p).alias("path"), resource.alias("resource"))


def queue_roles(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Producers and consumers of queues: key, role, queue, job, concurrency."""
    produce, consume = r"([A-Za-z_][A-Za-z0-9_]*)Queue\.add\(\s*['\"`]([^'\"`]+)['\"`]", r"new Worker\(\s*['\"`]([^'\"`]+)['\"`]\s*,\s*([A-Za-z_][A-Za-z0-9_]*)"
    text = F.col(code)
    # a hit reaches to the next one of its role, so that each worker has its own options
    row = lambda role, p: F.transform(F.regexp_extract_all(text, F.lit(rf"(?s){p}(?:(?!{p}).)*"), F.lit(0)), lambda h: F.struct(F.lit(role).alias("role"), F.regexp_extract(h, p, 1).alias("queue"), F.regexp_extract(h, p, 2).alias("job"), h.alias("t")))
    found = rows.where(text.rlike(produce) | text.rlike(consume)).select(key, F.explode(F.concat(row("producer", produce), row("consumer", consume))).alias("r"))
    limit = F.when(F.col("r.role") == "consumer", F.nullif(F.regexp_extract("r.t", r"concurrency:\s*([0-9]+)", 1), F.lit("")).cast("int"))
    return found.select(key, "r.role", "r.queue", "r.job", limit.alias("concurrency"))


def declarations(files: DataFrame) -> DataFrame:
    """Declarations by language: file_id, line, kind, name."""
    lines = lines_of(files, "file_id", "content", "code_lang")
    out = None
    for lang, patterns in DECLARATIONS.items():
        found = first_pattern(F.col("content"), patterns)
        out = F.when(F.col("code_lang") == lang, found) if out is None else out.when(F.col("code_lang") == lang, found)
    return lines.select("file_id", "line", out.alias("d")).where("d is not null").select("file_id", "line", "d.kind", F.col("d.value").alias("name"))


def conformances(files: DataFrame) -> DataFrame:
    """Types and what they conform to or extend: file_id, name, base. Generic arguments are left out."""
    p = r"^\s*(?:public\s+|final\s+|export\s+|default\s+|abstract\s+)*(?:struct|class|enum|actor|extension)\s+([A-Za-z0-9_]+)(?:<[^>]*>)?\s*(?::|extends|\()\s*([A-Za-z0-9_., ]+)"
    rows = lines_of(files, "file_id", "content").where(F.col("content").rlike(p)).select("file_id", F.regexp_extract("content", p, 1).alias("name"), F.explode(F.split(F.regexp_extract("content", p, 2), r"\s*,\s*")).alias("base"))
    return rows.select("file_id", "name", F.trim("base").alias("base")).where("base <> ''").distinct()


def view_navigation(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Views that a text leads to: key, view."""
    p = r"(?:destination:|sheet\s*\{|fullScreenCover\s*\{|present\()\s*([A-Z][A-Za-z0-9_]*)\("
    return rows.where(F.col(code).isNotNull()).select(key, F.explode(F.array_distinct(F.regexp_extract_all(code, F.lit(p), F.lit(1)))).alias("view"))


def interface_fields(files: DataFrame) -> DataFrame:
    """Fields of TypeScript interfaces and how often their repo's files read them: repo, field, declared, used, usage.

    A use is a member access (.field) in any newest file of the repo; both sides are counted before they meet.
    """
    lines = lines_of(files.where("code_lang = 'typescript'"), "file_id", "content", "repo")
    w = Window.partitionBy("file_id").orderBy("line")
    opened = F.when(F.col("content").rlike(r"^\s*(?:export\s+)?interface\s+[A-Za-z0-9_]+.*\{\s*$"), 1).when(F.col("content").rlike(r"^\s*\}"), 0)
    inside = F.coalesce(F.last(opened, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    field = F.regexp_extract("content", r"^\s*(?:readonly\s+)?([A-Za-z_][A-Za-z0-9_]*)\??\s*:", 1)
    declared = lines.withColumn("inside", inside).withColumn("field", field).where("inside = 1 and field <> ''").groupBy("repo", "field").agg(F.count(F.lit(1)).alias("declared"))
    uses = files.where("content is not null").select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"\.([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("field")).groupBy("repo", "field").agg(F.count(F.lit(1)).alias("used"))
    j = declared.join(uses, ["repo", "field"], "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    return j.select("repo", "field", "declared", "used", F.when(F.col("used") > 0, "used").otherwise("unused").alias("usage"))


def document_links(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Wiki links and Markdown links of documents outside code fences and inline code: key, line, type, target.

    Header lines between --- marks at the start hold no links. Targets lose aliases, anchors, ./ and .md; web
    addresses and bare anchors are none. Documents' lines are numbered within the document only.
    """
    ls = F.col("ls")
    split = spread(documents.where(F.col(text).isNotNull()).select(key, text), key).where(F.col(text).rlike(r"\[\[|\]\(")).select(key, F.split(text, r"\r?\n").alias("ls"))
    closing = F.array_position(F.slice(F.transform(ls, trimmed), 2, F.greatest(F.size(ls) - 1, F.lit(0))), "---")
    body = F.when((trimmed(F.get(ls, F.lit(0))) == "---") & (closing > 0), closing + 1).otherwise(0)
    marks = F.array_compact(F.transform(ls, lambda x, i: F.when(x.rlike(r"^\s*(```|~~~)"), i + 1)))
    parted = split.select(key, "ls", body.alias("b"), F.filter(marks, lambda p: p > body).alias("fences"))
    # the parity of fences before a line tells whether it is code; lines without a bracket of a link are not taken apart
    told = F.filter(F.transform(ls, lambda x, i: F.struct((i + 1).alias("line"), x.alias("content"))), lambda x: (x["line"] > F.col("b")) & x["content"].rlike(r"\[\[|\]\("))
    lines = parted.select(key, "fences", F.inline(told)).where(~F.array_contains("fences", F.col("line")) & (F.size(F.filter("fences", lambda p: p < F.col("line"))) % 2 == 0))
    plain = lines.select(key, "line", F.regexp_replace("content", r"`[^`]*`", "").alias("content"))
    wiki = F.transform(F.regexp_extract_all("content", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.struct(F.lit("wikilink").alias("type"), wiki_target(x).alias("target")))
    web = F.transform(F.regexp_extract_all("content", F.lit(r"(?:^|[^!])\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda x: F.struct(F.lit("markdown-link").alias("type"), markdown_target(x).alias("target")))
    hits = plain.select(key, "line", F.explode(F.concat(wiki, web)).alias("h"))
    return hits.select(key, "line", "h.type", "h.target").where("target is not null and target <> ''").distinct()


def wiki_target(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trimmed(F.regexp_extract(x, r"^([^|#]*)", 1)), r"^\./", ""), r"(?i)\.md$", "")


def markdown_target(x: Column) -> Column:
    t = trimmed(x)
    return F.when(t.rlike(r"^(#|//|[A-Za-z][A-Za-z0-9+.-]*:)"), None).otherwise(trimmed(F.regexp_extract(t, r"^<?([^#?>\s]*)", 1)))


def document_relations(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Typed relations of documents' headers: key, field, target (inline lists only)."""
    head = F.regexp_extract(F.col(text), r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    rows = documents.where(head != "").select(key, F.explode(F.split(head, r"\r?\n")).alias("l"))
    p = r"^([A-Za-z_][A-Za-z0-9_-]*):\s*(.*)$"
    fields = rows.where(F.col("l").rlike(p)).select(key, F.lower(F.regexp_extract("l", p, 1)).alias("field"), F.regexp_extract("l", p, 2).alias("v")).where(F.col("field").isin(*RELATIONS))
    values = fields.select(key, "field", F.explode(F.split(F.regexp_replace(trimmed(F.col("v")), r"^\[|\]$", ""), ",")).alias("v"))
    return values.select(key, "field", wiki_target(F.regexp_replace(trimmed(F.col("v")), r"^[\"']|[\"']$", "")).alias("target")).where("target <> ''").distinct()


def document_identities(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The lookup of declared ids: identity (lower case), and the document if it is the only one that declares it."""
    ident = F.lower(F.regexp_extract(F.col(text), r"^---\r?\n(?:[\s\S]*?\r?\n)?id:[ \t]*([^\r\n]+?)[ \t]*\r?\n", 1))
    return documents.select(key, ident.alias("identity")).where("identity <> ''").groupBy("identity").agg(F.count(F.lit(1)).alias("documents"), F.when(F.count(F.lit(1)) == 1, F.min(key)).alias("document"))


def describe_schedule(schedule: Column) -> Column:
    """Words for a cron schedule: nine fixed ones, daily times (also of odd minutes), steps of minutes and hours, else itself."""
    out = None
    for k, v in SCHEDULES.items():
        out = F.when(schedule == k, v) if out is None else out.when(schedule == k, v)
    p = F.split(F.trim(schedule), r"\s+")
    m, h, rest = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.array_join(F.slice(p, 3, 3), " ")
    pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    many = F.size(p) >= 5
    return (
        out.when(many & (m != "*") & (h != "*") & (rest == "* * *"), F.concat(F.lit("Daily at "), pad(h), F.lit(":"), pad(m)))
        .when(many & F.startswith(m, F.lit("*/")), F.concat(F.lit("Every "), F.substring(m, 3, 99), F.lit(" minutes")))
        .when(many & F.startswith(h, F.lit("*/")), F.concat(F.lit("Every "), F.substring(h, 3, 99), F.lit(" hours")))
        .otherwise(schedule)
    )


def infrastructure(source_files: DataFrame) -> DataFrame:
    """Repos by the kind of infrastructure that their paths tell of: repo, infrastructure, files."""
    path = clean_path(F.col("file"))
    kinds = F.array_compact(F.array(*[F.when(path.rlike(p), F.lit(k)) for k, p in INFRASTRUCTURE]))
    return source_files.where("file is not null").select("repo", path.alias("path"), F.explode(kinds).alias("infrastructure")).distinct().groupBy("repo", "infrastructure").agg(F.count(F.lit(1)).alias("files"))


def npm_manifest(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Packages of package.json texts: key, package, version (prefix cut), scope (core, dev). A package in both lists gives two rows; malformed texts none."""
    parsed = F.from_json(F.col(text), "dependencies map<string,string>, devDependencies map<string,string>", {"mode": "PERMISSIVE"})

    def listed(part: str, scope: str) -> Column:
        entries = F.coalesce(F.map_entries(parsed[part]), F.array().cast("array<struct<key:string,value:string>>"))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("package"), F.regexp_replace(e["value"], r"^[\^~>=<\s]+", "").alias("version"), F.lit(scope).alias("scope")))

    lists = F.concat(listed("dependencies", "core"), listed("devDependencies", "dev"))
    return rows.where(F.col(text).isNotNull()).select(key, F.explode(lists).alias("p")).select(key, "p.package", "p.version", "p.scope")


def pip_requirements(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Packages of requirements texts: key, package (lower case, extras cut), version (first number; null if none)."""
    l = F.trim("content")
    lines = lines_of(rows, key, text).where(~l.rlike(r"^(#|-|$)"))
    name = F.lower(F.regexp_extract(l, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    return lines.select(key, name.alias("package"), F.nullif(F.regexp_extract(l, r"[=<>~!]=?\s*([0-9][0-9A-Za-z.]*)", 1), F.lit("")).alias("version")).where("package <> ''")


def procfile(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Processes of a Procfile: key, process, command, kind (web, worker, other)."""
    p = r"^([A-Za-z0-9_-]+):\s*(.+)$"
    got = lines_of(rows, key, text).where(F.col("content").rlike(p)).select(key, F.regexp_extract("content", p, 1).alias("process"), F.trim(F.regexp_extract("content", p, 2)).alias("command"))
    return got.withColumn("kind", F.when(F.col("process") == "web", "web").when(F.contains("process", F.lit("worker")), "worker").otherwise("other"))


def compare_fields(schema_fields: DataFrame, type_fields: DataFrame) -> DataFrame:
    """Fields of a model beside those of a type (model, field, type each): model, field, verdict.

    match, mismatch, missing (in the model only) or extra (in the type only). Repeated fields: the first type by order holds.
    """
    a = schema_fields.groupBy("model", "field").agg(F.min("type").alias("a"))
    b = type_fields.groupBy("model", "field").agg(F.min("type").alias("b"))
    j = a.join(b, ["model", "field"], "full")
    return j.select("model", "field", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.lower("a") == F.lower("b"), "match").otherwise("mismatch").alias("verdict"))
