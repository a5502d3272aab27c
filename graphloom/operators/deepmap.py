"""Work packets for outside reviewers: groups of components, checks of what comes back, summaries and diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .skew import numbered

#: Limits of packets and findings, and the kinds of findings.
NODES_PER_PACKET, MIN_GROUP = 60, 3
FINDINGS, EVIDENCE, TEXT_LENGTH, EVIDENCE_LENGTH = 40, 5, 600, 200
KINDS = ("responsibility", "risk", "coupling", "dead-code", "data-flow", "duplication", "llm-usage", "recommendation")
FINDING_SCHEMA = "array<struct<component_id:string,kind:string,text:string,evidence:array<string>,confidence:double>>"


def packet_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups of each repo by layer, most connected first, at most 60 a part; layers of under 3 join in ``residual``.

    repo, label, part, component_id. Parts are cut in order of degree and id.
    """
    both = edges.select(F.explode(F.array("from_id", "to_id")).alias("component_id")).where("component_id is not null").groupBy("component_id").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.select("repo", "component_id", F.coalesce("layer", F.lit("external")).alias("layer")).join(both, "component_id", "left")
    sizes = n.groupBy("repo", "layer").agg(F.count(F.lit(1)).alias("n"))
    labelled = n.join(sizes, ["repo", "layer"]).withColumn("label", F.when(F.col("n") < MIN_GROUP, "residual").otherwise(F.concat(F.lit("layer-"), "layer")))
    placed = numbered(labelled.select("repo", "label", F.coalesce("degree", F.lit(0)).alias("degree"), "component_id"), ["repo", "label"], [F.desc("degree"), "component_id"])
    return placed.select("repo", "label", (F.floor((F.col("position") - 1) / NODES_PER_PACKET) + 1).cast("int").alias("part"), "component_id")


def ingest(results: DataFrame, packets: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of result rows (packet_id, json) against known components and files, each with its verdict.

    packet_id, position, component_id, kind, text, evidence, confidence, rejection (null if accepted). Reasons in
    order: unreadable, over_limit (more than 40), unknown_component (also outside the packet unless its tier is 3),
    schema_violation, missing_evidence (no entry names a known file, alone or before : or #). Texts are cut at 600 and
    evidence at 200 characters and 5 entries; confidence is clamped, 0.5 by default. ``packets``: packet_id, tier,
    component_ids.
    """
    parsed = results.select("packet_id", F.from_json("json", FINDING_SCHEMA).alias("f"))
    bad = parsed.where("f is null").select("packet_id", F.lit(-1).alias("position"), *[F.lit(None).cast(t).alias(c) for c, t in (("component_id", "string"), ("kind", "string"), ("text", "string"), ("evidence", "array<string>"), ("confidence", "double"))], F.lit("unreadable").alias("rejection"))
    rows = parsed.where("f is not null").select("packet_id", F.posexplode("f").alias("position", "f")).select("packet_id", "position", "f.*")
    known = nodes.select("component_id").distinct().withColumn("known", F.lit(True))
    scoped = rows.join(packets.select("packet_id", "tier", "component_ids"), "packet_id", "left").join(known, "component_id", "left")
    entries = F.slice(F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: e.isNotNull() & (e != "")), 1, EVIDENCE)
    scoped = scoped.withColumn("entries", F.transform(entries, lambda e: F.substring(e, 1, EVIDENCE_LENGTH))).withColumn("row", F.struct("packet_id", "position"))
    paths = files.where("file is not null").select(F.col("file").alias("path")).distinct()
    named = scoped.select("row", F.explode("entries").alias("e")).select("row", F.explode(F.array_distinct(F.array("e", F.regexp_extract("e", "^([^:]+):", 1), F.regexp_extract("e", "^([^#]+)#", 1)))).alias("path")).join(paths, "path", "left_semi").select(F.col("row").alias("hit_row")).distinct().withColumn("grounded", F.lit(True))
    j = scoped.join(named, F.col("row") == F.col("hit_row"), "left")
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x1F]+", " "))
    reason = (
        F.when(F.col("position") >= FINDINGS, "over_limit")
        .when(F.col("known").isNull() | ((F.coalesce("tier", F.lit(1)) != 3) & ~F.coalesce(F.array_contains("component_ids", F.col("component_id")), F.lit(False))), "unknown_component")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) | (text == ""), "schema_violation")
        .when((F.size("entries") == 0) | F.col("grounded").isNull(), "missing_evidence")
    )
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("confidence").isNotNull() & ~F.isnan("confidence"), F.col("confidence")).otherwise(0.5)))
    good = j.select("packet_id", "position", "component_id", "kind", F.substring(text, 1, TEXT_LENGTH).alias("text"), F.col("entries").alias("evidence"), confidence.alias("confidence"), reason.alias("rejection"))
    return good.unionByName(bad)


def executive_summary(nodes: DataFrame, violations: DataFrame) -> DataFrame:
    """Risks by severity and type, in rows: severity, type, items. Architecture errors are critical."""
    broken = violations.where("severity = 'error' and rule_id <> 'vulnerable-dependency'").select(F.lit("critical").alias("severity"), F.lit("architecture_rule").alias("type"))
    level = F.when(F.col("status") == "vulnerable", "critical").when(F.col("status") == "deprecated", "high").when(F.col("status") == "outdated", "medium").when(F.col("status") == "unused", "low")
    states = nodes.select(level.alias("severity"), F.col("status").alias("type")).where("severity is not null")
    return broken.unionByName(states).groupBy("severity", "type").agg(F.count(F.lit(1)).alias("items"))


def diagram_lines(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """Lines of a Mermaid diagram of the ``top`` most connected components and the edges between them: kind, line."""
    both = edges.select(F.explode(F.array("from_id", "to_id")).alias("component_id")).where("component_id is not null").groupBy("component_id").agg(F.count(F.lit(1)).alias("degree"))
    best = nodes.select("component_id", "name").join(both, "component_id").orderBy(F.desc("degree"), "component_id").limit(top)
    key = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    boxes = best.select(F.lit("node").alias("kind"), F.concat(key(F.col("component_id")), F.lit('["'), F.regexp_replace("name", '"', "'"), F.lit('"]')).alias("line"))
    ids = best.select("component_id")
    inner = edges.select("from_id", "to_id", "connection_type").join(ids.withColumnRenamed("component_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("component_id", "to_id"), "to_id", "left_semi").distinct()
    arrows = inner.select(F.lit("edge").alias("kind"), F.concat(key(F.col("from_id")), F.lit(" -->|"), "connection_type", F.lit("| "), key(F.col("to_id"))).alias("line"))
    return boxes.unionByName(arrows)
