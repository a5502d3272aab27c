"""Views over several repositories, model calls, prompts and event journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Purposes of model calls by words in names, in order; and by folder.
PURPOSES = (
    ("chart|visual|plot|diagram", "chart-generation"), ("rerank|rank", "reranking"), ("summar", "summarization"), ("embed", "embedding"), ("extract", "extraction"), ("entity|ner|relation", "entity-extraction"),
    ("theme|topic|cluster", "theme-extraction"), ("trend|forecast", "trend-analysis"), ("classif|categor|label", "classification"), ("search|query|retriev", "search"), ("translat", "translation"),
    ("chat|convers|dialog", "chat"), ("agent|tool|function.?call", "agent"), ("synthe[sz]", "synthesis"), ("chunk", "chunking"), ("ingest|scrape|crawl|fetch.*rss", "ingestion"), ("aggregat", "aggregation"),
    ("generat|produc", "generation"), ("fallback|retry|backup", "fallback"), ("validat|verif", "validation"), ("analyz|analys", "analysis"),
)
FOLDERS = (
    ("/search/", "search"), ("/synthesis/", "synthesis"), ("/knowledge-graph/", "knowledge-graph"), ("/kg/", "knowledge-graph"), ("/queue/", "queue-processing"), ("/queues/", "queue-processing"), ("/workers?/", "worker"),
    ("/ai/", "ai-core"), ("/llm/", "ai-core"), ("/services/", "service"), ("/adapters?/", "adapter"), ("/ingestion/", "ingestion"), ("/aggregation/", "aggregation"), ("/analytics?/", "analytics"),
)
#: Classes of edges that are no use, and symbols that say nothing about the purpose of a call.
UNUSED_CLASSES = ("test", "dev-only", "migration")
PLAIN_SYMBOLS = (
    "create", "call", "invoke", "run", "execute", "send", "post", "get", "fetch", "from", "init", "setup", "config", "use", "with", "wrap", "log", "emit", "on", "off", "set", "add", "remove", "update", "delete", "load", "save",
    "start", "stop", "open", "close", "connect", "disconnect", "enabled", "disabled", "model", "capture", "samplingRate", "tracing_enabled", "langsmith_enabled", "traceable", "fromZodSchema", "withRetry", "default", "module", "exports", "require", "import",
)
PROVIDER_SYMBOLS = ("openai", "anthropic", "groq", "cohere", "mistral", "replicate", "chatopenai", "chatgroq", "chatanthropic", "chatmistral", "langsmith", "langchain")
OBSERVERS = ("langsmith", "datadog", "opentelemetry", "sentry")
#: Prompt categories by words, in order.
PROMPT_CATEGORIES = (("summari[sz]e|summary", "summarization"), ("extract|parse", "extraction"), ("classify|categorize", "classification"), ("translate", "translation"), ("tool|function_call", "agent"), ("embed", "embedding"), ("chat|conversation", "chat"))


def purpose_of(symbol, file):
    base = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]+$", "")
    out = None
    for where in (symbol, base):
        for pattern, name in PURPOSES:
            cond = F.coalesce(F.lower(where).rlike(pattern), F.lit(False))
            out = F.when(cond, name) if out is None else out.when(cond, name)
    for pattern, name in FOLDERS:
        out = out.when(F.coalesce(F.lower(file).rlike(pattern), F.lit(False)), name)
    return out


def use_cases(nodes: DataFrame, edges: DataFrame, prompts: DataFrame) -> DataFrame:
    """Uses of models, one per repo and file that calls one: repo, file, call_sites, providers, main_provider, purpose,
    grouped_by (prompt, function or file).

    Edges to components of type llm count, without those of tests, development and migrations, imports that no call of
    the same file to the same model accompanies, and repeats of file, symbol and model. The purpose is the category of
    the first prompt (by seq) that lies in the file or is used by it, else what the first telling symbol (by seq), the
    file's name or its folder says. The main provider is no observer unless there is nothing else, then the first name.
    """
    models = nodes.where("component_type = 'llm'").select(F.col("component_id").alias("to_id"), F.col("name").alias("provider"))
    calls = edges.where("file is not null").select("seq", "repo", "file", "symbol", "to_id", "connection_type", "classification").join(models, "to_id").where(~F.coalesce(F.col("classification").isin(*UNUSED_CLASSES), F.lit(False)))
    one = calls.groupBy("repo", "file", "symbol", "to_id", "provider").agg(F.min("seq").alias("seq"), F.bool_or(F.col("connection_type") != "imports").alias("call"))
    per = one.groupBy("repo", "file", "to_id", "provider").agg(F.bool_or("call").alias("called"))
    kept = one.join(per.where("called").select("repo", "file", "to_id"), ["repo", "file", "to_id"], "left_semi")
    telling = (F.length("symbol") >= 3) & ~F.col("symbol").isin(*PLAIN_SYMBOLS) & ~F.lower("symbol").isin(*PROVIDER_SYMBOLS) & ~F.col("symbol").rlike(r"^anonymous_\d+$|^(\./|/|\.\.)")
    kept = kept.withColumn("told", F.when(telling, purpose_of(F.col("symbol"), F.col("file"))))
    told = F.col("told")
    files = kept.groupBy("repo", "file").agg(
        F.count(F.lit(1)).alias("call_sites"), F.countDistinct("to_id").alias("providers"), F.min_by("provider", F.struct(F.lower("provider").isin(*OBSERVERS).alias("o"), F.col("provider").alias("p"))).alias("main_provider"),
        F.min_by(told, F.when(told.isNotNull(), F.col("seq"))).alias("by_symbol"),
    )
    known = prompts.where("category is not null and category <> 'unknown'").select("repo", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("file"), F.coalesce("used_by", F.array().cast("array<string>")))))).alias("file"), "seq", "category")
    first = known.groupBy("repo", "file").agg(F.min_by("category", "seq").alias("by_prompt"))
    rows = files.join(first, ["repo", "file"], "left")
    how = F.when(F.col("by_prompt").isNotNull(), "prompt").when(F.col("by_symbol").isNotNull(), "function").otherwise("file")
    return rows.select("repo", "file", "call_sites", "providers", "main_provider", F.coalesce("by_prompt", "by_symbol", purpose_of(F.lit(""), F.col("file"))).alias("purpose"), how.alias("grouped_by"))


def shared_dependencies(nodes: DataFrame) -> DataFrame:
    """External dependencies of at least two repos by stable id: repos, versions, version_skew (a null version is one).

    A repo's version is that of its first component (by seq).
    """
    key = F.coalesce("stable_id", F.concat_ws("|", F.lower("name"), "component_type"))
    per = nodes.where("layer = 'external'").groupBy(key.alias("dependency"), "repo").agg(F.min_by(F.coalesce("version", F.lit("")), "seq").alias("version"))
    return per.groupBy("dependency").agg(F.count(F.lit(1)).alias("repos"), F.countDistinct("version").alias("versions")).where("repos >= 2").select("dependency", "repos", "versions", (F.col("versions") > 1).alias("version_skew"))


def service_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Heuristic calls between repos by service name: from_repo, from_id, connection_type, service, other_repos.

    Each caller refers to the class of services of one name instead of to all pairs; ``service_members`` lists the class.
    Only classes with a member in another repo count.
    """
    types = edges.where("connection_type in ('service-call', 'runtime-binding')").select("repo", "from_id", "to_id", "connection_type")
    target = nodes.select(F.col("component_id").alias("to_id"), F.lower("name").alias("service"))
    members = service_members(nodes).groupBy("service").agg(F.countDistinct("repo").alias("repos"), F.min("repo").alias("one_repo"))
    mine = service_members(nodes).select("service", F.col("repo").alias("own_repo")).distinct()
    calls = types.join(target, "to_id").select(F.col("repo").alias("from_repo"), "from_id", "connection_type", "service").distinct().join(members, "service")
    own = calls.join(mine, (calls["service"] == mine["service"]) & (calls["from_repo"] == mine["own_repo"]), "left").select("from_repo", "from_id", "connection_type", calls["service"], (F.col("repos") - F.when(F.col("own_repo").isNotNull(), 1).otherwise(0)).cast("long").alias("other_repos"))
    return own.where("other_repos > 0")


def service_members(nodes: DataFrame) -> DataFrame:
    """Services by lower-case name: service, repo, component_id."""
    return nodes.where("component_type = 'service' and name is not null").select(F.lower("name").alias("service"), "repo", "component_id")


def portfolio_status(nodes: DataFrame, edges: DataFrame, as_of: str, stale_hours: int = 24) -> DataFrame:
    """One row: repos, components, connections, stale_repos (newest detection older than the limit at ``as_of``)."""
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("c"))
    e = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("x"), F.max("detected_at").alias("last"))
    stale = F.col("last") < F.lit(as_of).cast(dict(edges.dtypes)["detected_at"]) - F.expr(f"interval {stale_hours} hours")
    return n.join(e, "repo", "full").agg(F.count(F.lit(1)).alias("repos"), F.sum("c").alias("components"), F.sum("x").alias("connections"), F.count_if(stale).alias("stale_repos"))


def prompt_category(content):
    low = F.lower(content)
    out = None
    code = F.contains(low, F.lit("code"))
    for i, (pattern, name) in enumerate(PROMPT_CATEGORIES):
        if i == 4:
            out = out.when(code & low.rlike("write|generate"), "code-generation").when(code & F.contains(low, F.lit("review")), "code-review")
        cond = low.rlike(pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("unknown")


def prompt_summary(prompts: DataFrame) -> DataFrame:
    """Prompts (re-deliveries once) per provider and detected category: prompts, templated, mean_tokens."""
    one = prompts.where("content is not null").groupBy("prompt_id").agg(F.max_by(F.struct("provider", "content", "variables", "token_count"), F.struct("arrived_at", "seq")).alias("p")).select("p.*")
    return one.groupBy("provider", prompt_category(F.col("content")).alias("detected")).agg(F.count(F.lit(1)).alias("prompts"), F.count_if(F.size(F.coalesce("variables", F.array().cast("array<string>"))) > 0).alias("templated"), F.round(F.avg("token_count"), 4).alias("mean_tokens"))


#: Fixed value: the placeholder syntaxes of templates.
VARIABLE = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}|\$\{([A-Za-z_][A-Za-z0-9_]*)\}|\{([A-Za-z_][A-Za-z0-9_]*)\}"


def template_variables(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct variables of templates, one row each: key, variable."""
    groups = [F.regexp_extract_all(F.col(text), F.lit(VARIABLE), F.lit(i)) for i in (1, 2, 3)]
    names = F.array_distinct(F.filter(F.concat(*groups), lambda x: x != ""))
    return rows.where(F.col(text).isNotNull()).select(key, F.explode(names).alias("variable"))


def user_memory(events: DataFrame) -> DataFrame:
    """Journal folded per user: events, errors, purchases' value, first and last seen, the latest value that is not null."""
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("value"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))).alias("latest_value"),
    )


def last_events(events: DataFrame, per_user: int = 40) -> DataFrame:
    """The newest ``per_user`` events of each user with their position; users' days are cut first, so that one user's
    whole history is not sorted by one task."""
    day = F.to_date("ts")
    local = Window.partitionBy("user_id", day).orderBy(F.desc("ts"), F.desc("event_id"))
    best = events.select("user_id", "ts", "event_id", "event_type").withColumn("r", F.row_number().over(local)).where(F.col("r") <= per_user)
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return best.withColumn("position", F.row_number().over(w)).where(F.col("position") <= per_user).select("user_id", "position", "event_id", "event_type")


def journal_health(events: DataFrame, least_days: float = 1.0) -> DataFrame:
    """One row: records, errors, window_days, registers (signups), per_day (0 where the window is shorter than a day)."""
    days = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 86_400_000_000.0
    g = events.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("event_type") == "error").alias("errors"), days.alias("d"), F.count_if(F.col("event_type") == "signup").alias("registers"))
    return g.select("records", "errors", F.round(F.coalesce("d", F.lit(0.0)), 6).alias("window_days"), "registers", F.round(F.when(F.col("d") >= least_days, F.col("registers") / F.col("d")).otherwise(0.0), 6).alias("per_day"))


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions of users (our addition): user_id, session_start, events; a gap of more than ``gap_minutes`` parts them."""
    return events.groupBy("user_id", F.session_window("ts", f"{gap_minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "events")
