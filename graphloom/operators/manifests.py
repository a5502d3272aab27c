"""What manifests and schemas declare: entry files, dependencies of compiled packages, and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .graph_views import clean_path

_PACKAGE = "main string, module string, browser string, bin string, exports string, scripts map<string,string>, files array<string>"
#: A path of a code file in a script, folders of build output, and extensions that source may have.
SCRIPT_PATH = r"^[A-Za-z0-9_.@][A-Za-z0-9_.@/-]*\.[cm]?[jt]sx?$"
OUTPUT_FOLDERS = "dist|build|lib|out"
SOURCE_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".jsx", ".js", ".mjs", ".cjs")
#: Scalar types of schema models.
SCALARS = ("String", "Int", "Float", "Boolean", "DateTime", "Json", "Bytes", "BigInt", "Decimal")


def _string_values(json: Column) -> Column:
    """All strings of a JSON text that are values, but those of the key types; a bare string is itself."""
    strings = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))  # keys with their colon
    kept = F.filter(strings, lambda x, i: ~F.endswith(x, F.lit(":")) & ~F.coalesce(F.get(strings, i - 1).rlike(r'^"types"\s*:'), F.lit(False)))
    values = F.transform(kept, lambda x: F.substring(x, 2, F.length(x) - 2))
    return F.when(json.rlike(r"^\s*[{\[]"), values).otherwise(F.array(json))


def declared_entries(files: DataFrame) -> DataFrame:
    """Source paths that package manifests declare as entries: repo, path, source (package-entry, -script or -file).

    ``files``: repo, file, content; only files named package.json count, those that are no JSON give nothing. main,
    module, browser, bin, exports (all of its conditions but types), code files in scripts, and files by name. A
    declared build output stands for the source files it may come from, so a path need not exist. Patterns with * and
    paths that leave the folder are none.
    """
    named = files.where(clean_path(F.col("file")).rlike(r"(^|/)package\.json$"))
    p = named.select("repo", F.regexp_replace(clean_path(F.col("file")), r"[^/]*$", "").alias("dir"), F.from_json("content", _PACKAGE).alias("p")).where("p is not null")
    none = F.array().cast("array<string>")
    tokens = F.flatten(F.transform(F.coalesce(F.map_values("p.scripts"), F.array().cast("array<string>")), lambda c: F.split(c, r"[\s'\"`;=(),]+")))
    told = {
        "package-entry": F.concat(F.array("p.main", "p.module", "p.browser"), F.coalesce(_string_values(F.col("p.bin")), none), F.coalesce(_string_values(F.col("p.exports")), none)),
        "package-script": F.filter(tokens, lambda t: t.rlike(SCRIPT_PATH)),
        "package-file": F.filter(F.coalesce("p.files", none), lambda t: t.rlike(r"\.[A-Za-z0-9]+$")),
    }
    rows = None
    for source, values in told.items():
        one = p.select("repo", "dir", F.lit(source).alias("source"), F.explode(F.array_compact(values)).alias("target"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.where((F.col("target") != "") & ~F.contains("target", F.lit("*"))).withColumn("target", F.regexp_replace("target", r"^\./", ""))
    rows = rows.where(~F.startswith("target", F.lit("/")) & ~F.array_contains(F.split("target", "/"), "..")).withColumn("target", F.concat("dir", "target"))
    bare = F.regexp_replace("target", rf"^({OUTPUT_FOLDERS})/", "")
    deep = rf"^(.*?/)({OUTPUT_FOLDERS})/(.*)$"
    nested = F.col("target").rlike(deep)
    bases = F.array_compact(F.array(F.col("target"), bare, F.concat(F.lit("src/"), bare), F.when(nested, F.regexp_replace("target", deep, "$1$3")), F.when(nested, F.regexp_replace("target", deep, "$1src/$3"))))
    stems = F.transform(bases, lambda b: F.regexp_replace(b, r"\.[cm]?[jt]sx?$", ""))
    grown = F.flatten(F.transform(stems, lambda s: F.array(*[F.concat(s, F.lit(e)) for e in SOURCE_EXTENSIONS], *[F.concat(s, F.lit(f"/index{e}")) for e in SOURCE_EXTENSIONS])))
    return rows.select("repo", "source", F.explode(F.array_distinct(F.concat(bases, grown))).alias("path")).groupBy("repo", "path").agg(F.min("source").alias("source"))


def cargo_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of Cargo manifests: repo, file, section, name, version (null where none is stated).

    Sections dependencies, dev-dependencies, build-dependencies and workspace.dependencies, with a plain version or an
    inline table; tables of one dependency ([dependencies.name]) count too.
    """
    named = files.where(clean_path(F.col("file")).rlike(r"(^|/)Cargo\.toml$") & F.col("content").isNotNull())
    blocks = F.regexp_extract_all("content", F.lit(r"(?m)^\[[^\]\n]+\][^\n]*(?:\n(?!\[)[^\n]*)*"), F.lit(0))
    b = named.select("repo", "file", F.explode(blocks).alias("b")).select("repo", "file", F.regexp_extract("b", r"^\[([^\]\n]+)\]", 1).alias("section"), F.split("b", r"\r?\n").alias("ls"))
    lists = b.where(F.col("section").isin("dependencies", "dev-dependencies", "build-dependencies", "workspace.dependencies")).select("repo", "file", "section", F.explode(F.slice("ls", 2, F.greatest(F.size("ls") - 1, F.lit(0)))).alias("l"))
    line = r"^\s*([A-Za-z0-9_-]+)\s*=\s*(?:\"([^\"]*)\"|\{(?:[^}]*?version\s*=\s*\"([^\"]*)\")?[^}]*\})"
    plain = lists.where(F.col("l").rlike(line)).select("repo", "file", "section", F.regexp_extract("l", line, 1).alias("name"), F.nullif(F.concat(F.regexp_extract("l", line, 2), F.regexp_extract("l", line, 3)), F.lit("")).alias("version"))
    one = r"^(dependencies|dev-dependencies|build-dependencies)\.([A-Za-z0-9_-]+)$"
    tables = b.where(F.col("section").rlike(one)).select("repo", "file", F.regexp_extract("section", one, 1).alias("section"), F.regexp_extract("section", one, 2).alias("name"), F.nullif(F.regexp_extract(F.array_join("ls", "\n"), r"(?m)^\s*version\s*=\s*\"([^\"]*)\"", 1), F.lit("")).alias("version"))
    return plain.unionByName(tables)


def schema_models(files: DataFrame) -> DataFrame:
    """Fields of the models of Prisma schemas: repo, file, model, table_name, field, field_type, is_array, is_optional,
    is_id, is_unique, relation (the model that a field refers to: stated, or of no scalar type; null for scalars)."""
    named = files.where(F.endswith("file", F.lit(".prisma")) & F.col("content").isNotNull())
    m = named.select("repo", "file", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*model\s+[A-Za-z_]\w*\s*\{[^}]*\}"), F.lit(0))).alias("m"))
    head = m.select("repo", "file", F.regexp_extract("m", r"model\s+(\w+)", 1).alias("model"), F.nullif(F.regexp_extract("m", r'@@map\(\s*"([^"]+)"\s*\)', 1), F.lit("")).alias("table_name"), F.explode(F.split(F.regexp_extract("m", r"\{([^}]*)\}", 1), r"\r?\n")).alias("l"))
    line = r"^(\w+)\s+(\w+)(\[\])?\??"
    t = F.trim("l")
    f = head.select("repo", "file", "model", "table_name", t.alias("l")).where(~F.startswith("l", F.lit("//")) & ~F.startswith("l", F.lit("@@")) & F.col("l").rlike(line))
    kind = F.regexp_extract("l", line, 2)
    relation = F.when(F.contains("l", F.lit("@relation(")) | (kind.rlike("^[A-Z]") & ~kind.isin(*SCALARS)), kind)
    has = lambda text: F.contains("l", F.lit(text))
    return f.select("repo", "file", "model", "table_name", F.regexp_extract("l", line, 1).alias("field"), kind.alias("field_type"), (F.regexp_extract("l", line, 3) != "").alias("is_array"), has("?").alias("is_optional"), has("@id").alias("is_id"), has("@unique").alias("is_unique"), relation.alias("relation"))
