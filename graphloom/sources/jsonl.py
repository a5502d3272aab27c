"""Reading and writing components, connections and snapshots as JSON lines, parquet and Markdown views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph_views import ends
from ..operators.skew import numbered

COMPONENT_SCHEMA = (
    "component_id string, stable_id string, name string, type string, version string, status string, tags array<string>, "
    "role struct<purpose:string,layer:string,critical:boolean>, source struct<detection_method:string,config_files:array<string>,confidence:double>, metadata string, timestamp long, last_updated long"
)
CONNECTION_SCHEMA = (
    "connection_id string, connection_type string, `from` struct<component_id:string,location:struct<file:string,line:int>>, to struct<component_id:string,location:struct<file:string,line:int>>, "
    "code_reference struct<file:string,symbol:string,symbol_type:string,line_start:int,code_snippet:string>, semantic struct<classification:string,confidence:double>, description string, detected_from string, confidence double, timestamp long, last_verified long"
)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file or folder; lines that are no JSON of the schema are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """Components flattened to the columns of the graph views; the first config file is the file."""
    r = read_lines(spark, path, COMPONENT_SCHEMA).where("component_id is not null")
    return r.select(
        "component_id", "stable_id", "name", F.col("type").alias("component_type"), "version", "status", "tags", F.col("role.purpose").alias("purpose"), F.col("role.layer").alias("layer"),
        F.coalesce("role.critical", F.lit(False)).alias("critical"), F.get("source.config_files", F.lit(0)).alias("file"), F.col("source.confidence").alias("confidence"),
        F.timestamp_millis("timestamp").alias("first_seen_at"), F.timestamp_millis("last_updated").alias("arrived_at"),
    )


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """Connections flattened to the columns of the graph views."""
    r = read_lines(spark, path, CONNECTION_SCHEMA).where("connection_id is not null")
    return r.select(
        "connection_id", F.col("from.component_id").alias("from_id"), F.col("to.component_id").alias("to_id"), "connection_type", F.coalesce("code_reference.file", "from.location.file").alias("file"),
        F.col("code_reference.symbol").alias("symbol"), F.coalesce("code_reference.line_start", "from.location.line").alias("line"), F.col("code_reference.code_snippet").alias("code"), "confidence",
        F.col("semantic.classification").alias("classification"), "detected_from", F.timestamp_millis("timestamp").alias("detected_at"), F.timestamp_millis("last_verified").alias("arrived_at"),
    )


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line; the commit protocol makes the folder visible as a whole."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def compact_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connections with short keys and resolved names, ? where an end is unknown."""
    named = ends(edges, nodes)
    return named.select(F.col("connection_id").alias("id"), F.coalesce("from_name", F.lit("?")).alias("f"), F.coalesce("to_name", F.lit("?")).alias("t"), F.col("connection_type").alias("ct"), F.col("file").alias("fl"), F.col("line").alias("ln"))


def markdown_views(nodes: DataFrame, edges: DataFrame, neighbours: int = 1000) -> DataFrame:
    """Markdown pages of each component with a header and its neighbours: component_id, page_no, page.

    A page lists ``neighbours`` per direction in order of names; a component with more goes on over pages 2, 3 and so
    on, so that nothing is left out and no list grows beyond a page. Each list's head says how many there are in all.
    """

    named = ends(edges, nodes)
    pairs = named.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit("out").alias("way"), F.coalesce("to_name", "to_id").alias("other")), F.struct(F.col("to_id").alias("id"), F.lit("in").alias("way"), F.coalesce("from_name", "from_id").alias("other")))).alias("p")).select("p.*")
    counted = pairs.groupBy("id", "way", "other").agg(F.count(F.lit(1)).alias("n"))
    known = counted.where("id is not null").select("id", "way", "other")
    placed = numbered(known, ["id", "way"], ["other"])
    kept = placed.withColumn("page_no", (F.floor((F.col("position") - 1) / neighbours) + 1).cast("int"))
    totals = known.groupBy("id", "way").agg(F.count(F.lit(1)).alias("all"))
    lines = kept.groupBy("id", "way", "page_no").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.coalesce("other", F.lit("?"))))), "\n").alias("list")).join(totals, ["id", "way"])
    title = F.when(F.col("way") == "out", "Connects to").otherwise("Connected from")
    body = F.concat(F.lit("## "), title, F.lit(" ("), F.col("all").cast("string"), F.lit(")\n"), F.col("list"))
    pages = lines.groupBy("id", "page_no").agg(F.max(F.when(F.col("way") == "out", body)).alias("out"), F.max(F.when(F.col("way") == "in", body)).alias("in"))
    j = nodes.join(pages, F.col("component_id") == F.col("id"), "left").withColumn("page_no", F.coalesce("page_no", F.lit(1)))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), "component_id"), F.concat(F.lit("type: "), "component_type"), F.concat(F.lit("layer: "), "layer"), F.concat(F.lit("status: "), "status"), F.lit("---"))
    return j.select("component_id", "page_no", F.concat_ws("\n\n", head, F.concat(F.lit("# "), "name"), "purpose", "out", "in").alias("page"))


def envelope(df: DataFrame, command: str) -> DataFrame:
    """Each row as a JSON envelope of a command's output with sorted keys."""
    data = F.struct(*[F.col(c) for c in sorted(df.columns)])
    return df.select(F.to_json(F.struct(F.lit(command).alias("command"), data.alias("data"), F.lit("1.0").alias("schema"))).alias("json"))
