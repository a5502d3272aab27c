"""Queries of the text problems over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .dress import collapsed, lesson_runs
from .encode import encode_corpus
from .handwritten import file_evidence, group_counts
from .mixture import mixture, reached_shares
from .secrets import credential_rows, searched_rows
from .split import split_documents


def _credentials(spark, d):
    rows = searched_rows(table(spark, d, "connections"), table(spark, d, "llm_calls"), table(spark, d, "prompts"))
    return credential_rows(rows, ["table_name", "seq"])


def p1_found(spark, d):
    return _credentials(spark, d).select("table_name", "seq")


def p1_masked(spark, d):
    return _credentials(spark, d).select("table_name", "seq", F.size("span_starts").alias("credentials"), "masked_text")


def p2_found(spark, d):
    return p2_evidence(spark, d).where("machine_made").select("file_id")


def p2_evidence(spark, d):
    return file_evidence(table(spark, d, "source_files"), table(spark, d, "package_files"))


def p2_groups(spark, d):
    return group_counts(table(spark, d, "partition_groups"), table(spark, d, "source_files"), p2_evidence(spark, d))


def p5_found(spark, d):
    return lesson_runs(table(spark, d, "lessons")).where("first_seq <> seq")


def p5_lessons(spark, d):
    return collapsed(table(spark, d, "lessons"))


def p7_ids(spark, d):
    return encode_corpus(table(spark, d, "documents"))


def p8_mixture(spark, d):
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return reached_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_pieces(spark, d):
    return split_documents(table(spark, d, "documents"), table(spark, d, "split_settings"))


def p9_summary(spark, d):
    pieces = split_documents(table(spark, d, "documents"), table(spark, d, "split_settings"))
    return pieces.groupBy("doc_kind", "cut_at").agg(F.count(F.lit(1)).alias("pieces"), F.max("n_tokens").alias("most_tokens"), F.sum("n_tokens").alias("tokens"))


QUERIES = {f.__name__: f for f in (p1_found, p1_masked, p2_found, p2_evidence, p2_groups, p5_found, p5_lessons, p7_ids, p8_mixture, p8_shares, p9_pieces, p9_summary)}

_LESSONS = r"""
WITH keyed AS (
  SELECT seq, regexp_replace(lower(category), '[^\p{L}\p{Nd}]', '', 'g') AS c, regexp_replace(lower(pattern), '[^\p{L}\p{Nd}]', '', 'g') AS p,
         list_sort(list_transform(coalesce(signature, []), lambda x: coalesce(regexp_replace(lower(x), '[^\p{L}\p{Nd}]', '', 'g'), chr(3)))) AS s
  FROM lessons WHERE pattern IS NOT NULL),
runs AS (SELECT seq, min(seq) OVER (PARTITION BY c, p, s) AS first_seq FROM keyed)
"""

SQL = {
    "p5_found": _LESSONS + "SELECT first_seq, seq FROM runs WHERE first_seq <> seq",
    "p5_lessons": _LESSONS + "SELECT first_seq, count(*) AS copies FROM runs GROUP BY 1 UNION ALL SELECT seq, 1 FROM lessons WHERE pattern IS NULL",
}
