"""Acceptance sampling, sequential tests, allocation, drift and defect verifiers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph_views import clean_path

#: Acceptance plans by lot size (upper bound, code letter, sample size, acceptance number).
AQL_PLANS = (
    (8, "A", 2, 0), (15, "B", 3, 0), (25, "C", 5, 0), (50, "D", 8, 0), (90, "E", 13, 1), (150, "F", 20, 1), (280, "G", 32, 2), (500, "H", 50, 3), (1200, "J", 80, 5), (3200, "K", 125, 7),
    (10000, "L", 200, 10), (35000, "M", 315, 14), (None, "N", 500, 21),
)
#: Strata of connection and component types.
CONNECTION_STRATA = {"connection-imports": ("imports", "uses-package"), "connection-services": ("service-call",), "connection-prisma": ("schema-relation", "api-calls-db", "field-reference"), "connection-llm": ("prompt-location", "prompt-usage")}
COMPONENT_STRATA = {"package": ("npm", "pip", "spm", "cargo", "go", "gem", "composer", "framework"), "infra": ("infra", "database", "queue", "cron", "config"), "connection-llm": ("llm",), "connection-services": ("service",)}
EWMA_LAMBDA, EWMA_WIDTH, EWMA_WARMUP = 0.2, 2.7, 5


def case_of(column: Column, strata: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit("__other")
    for name, types in reversed(strata.items()):
        out = F.when(column.isin(*types), name).otherwise(out)
    return out


def aql_plan(lots: DataFrame, size: str = "lot") -> DataFrame:
    """Adds code_letter, sample and accept to lots with a size; a lot smaller than the plan's sample is taken whole."""
    plan = None
    for top, letter, n, c in AQL_PLANS:
        row = F.struct(F.lit(letter).alias("code_letter"), F.lit(n).cast("long").alias("n"), F.lit(c).alias("accept"))
        cond = F.col(size) <= top if top is not None else F.lit(True)
        plan = F.when(cond, row) if plan is None else plan.when(cond, row)
    return lots.withColumn("__p", plan).select(*lots.columns, "__p.code_letter", F.least(F.col("__p.n"), F.greatest(F.col(size), F.lit(1))).cast("long").alias("sample"), "__p.accept")


def sprt(defects: Column, n: Column, p0: float, p1: float, alpha: float = 0.05, beta: float = 0.05) -> Column:
    """Verdict of a sequential probability ratio test on counts: reject, accept or continue."""
    if not 0 < p0 < p1 < 1:
        raise ValueError("0 < p0 < p1 < 1 is needed")
    ratio = defects * math.log(p1 / p0) + (n - defects) * math.log((1 - p1) / (1 - p0))
    return F.when(ratio >= math.log((1 - beta) / alpha), "reject").when(ratio <= math.log(beta / (1 - alpha)), "accept").otherwise("continue")


def cochran(p: float, e: float, population: Column, z: float = 1.96) -> Column:
    """Sample size with the finite population correction, rounded up; without a population the infinite one."""
    n0 = z * z * p * (1 - p) / (e * e)
    return F.ceil(F.when(population > 0, n0 / (1 + (n0 - 1) / population)).otherwise(n0)).cast("long")


def binomial_cdf(c: Column, n: Column, p: float) -> Column:
    """P(X <= c) of a binomial distribution by summed logarithms, exact to double precision for small c."""
    log_choose = lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda a, i: a + F.log(n - k + i) - F.log(i.cast("double")))
    term = lambda k: F.when(k > n, 0.0).otherwise(F.exp(F.when(k > 0, log_choose(F.greatest(k, F.lit(1)))).otherwise(0.0) + k * math.log(p) + (n - k) * math.log(1 - p)))
    return F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(0), c.cast("int")), F.lit(0.0), lambda a, k: a + term(k)))


def neyman(strata: DataFrame, total: int, size: str = "size", spread: str = "spread", key: str = "stratum") -> DataFrame:
    """Allocation of ``total`` samples in proportion to size times spread, capped by size, largest remainders first,
    what the caps leave over spread in key order. One row per stratum (few); key, size, allocated."""
    every = Window.partitionBy(F.lit(1))
    up = every.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    w = strata.withColumn("__w", F.col(size) * F.col(spread)).withColumn("__s", F.sum("__w").over(every)).withColumn("__k", F.count(F.lit(1)).over(every)).withColumn("__i", F.row_number().over(every.orderBy(key)))
    even = F.least(F.col(size), F.floor(F.lit(total) / F.col("__k")) + F.when(F.col("__i") <= F.lit(total) - F.floor(F.lit(total) / F.col("__k")) * F.col("__k"), 1).otherwise(0))
    capped = F.least(F.lit(total) * F.col("__w") / F.when(F.col("__s") > 0, F.col("__s")), F.col(size).cast("double"))
    w = w.withColumn("__r", capped).withColumn("__f", F.floor("__r")).withColumn("__left", F.lit(total) - F.sum("__f").over(every))
    w = w.withColumn("__rank", F.row_number().over(every.orderBy(F.desc(F.col(size) > F.col("__f")), F.desc(F.col("__r") - F.col("__f")), key)))
    w = w.withColumn("__g", F.col("__f") + F.when((F.col("__rank") <= F.col("__left")) & (F.col(size) > F.col("__f")), 1).otherwise(0))
    w = w.withColumn("__owed", F.lit(total) - F.sum("__g").over(every)).withColumn("__room", F.col(size) - F.col("__g")).withColumn("__before", F.coalesce(F.sum("__room").over(up), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col("__room"), F.col("__owed") - F.col("__before")))
    return w.select(key, F.col(size).alias("size"), F.when(F.col("__s") > 0, F.col("__g") + more).otherwise(even).cast("long").alias("allocated"))


def stratified_sample(rows: DataFrame, key: str, stratum: str, per_stratum: int, seed: str = "1") -> DataFrame:
    """``per_stratum`` rows of each stratum without replacement, in the order of a seeded hash (stable, no shuffle of
    a generator). Each task first keeps only its own best, so a hot stratum never meets in one task as a whole."""
    order = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))
    part = rows.select(F.col(key), F.col(stratum), order.alias("__h")).withColumn("__b", F.pmod(F.hash("__h"), F.lit(256)))
    local = Window.partitionBy(stratum, "__b").orderBy("__h", key)
    best = part.withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= per_stratum)
    final = Window.partitionBy(stratum).orderBy("__h", key)
    return best.withColumn("position", F.row_number().over(final)).where(F.col("position") <= per_stratum).select(stratum, "position", key)


def ewma(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Drift chart of each key's series: key, at, n, z, limit, breach.

    The first five values fix mean and population variance; from then on z = 0.2 (x - mean) + 0.8 z, with limits of
    2.7 stabilised standard errors. A series is ordered by ``at``, one value each; it is a summary (per day, per
    scan), not raw records, and is charted in one pass. A null value is no observation.
    """
    types = dict(series.dtypes)

    def chart(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        x = pdf[value].to_numpy(float)
        warm = x[:EWMA_WARMUP]
        mean, spread = warm.mean(), max(((warm - warm.mean()) ** 2).mean(), 1e-12) ** 0.5
        z, last = np.zeros(len(x)), 0.0
        for i in range(EWMA_WARMUP, len(x)):
            z[i] = last = EWMA_LAMBDA * (x[i] - mean) + (1 - EWMA_LAMBDA) * last
        k = np.arange(len(x)) + 1 - EWMA_WARMUP
        limit = np.where(k > 0, EWMA_WIDTH * spread * np.sqrt(EWMA_LAMBDA / (2 - EWMA_LAMBDA) * (1 - (1 - EWMA_LAMBDA) ** (2.0 * np.maximum(k, 0)))), 0.0)
        return pd.DataFrame({key: pdf[key], at: pdf[at], "n": np.arange(1, len(x) + 1), "z": z.round(9), "limit": limit.round(9), "breach": (k > 0) & (np.abs(z) > limit)})

    rows = series.select(key, at, value).where(F.col(value).isNotNull())
    return rows.groupBy(key).applyInPandas(chart, f"`{key}` {types[key]}, `{at}` {types[at]}, n int, z double, limit double, breach boolean")


def wrong_endpoints(edges: DataFrame, source_files: DataFrame) -> DataFrame:
    """Edges whose symbol does not occur in the newest content of their file: connection_id.

    Only edges with a symbol and a known file count; an empty content holds no symbol.
    """
    newest = source_files.where("file is not null").groupBy("repo", "file").agg(F.max_by("content", F.struct("scanned_at", "file_id")).alias("content"))
    e = edges.where("symbol <> '' and file is not null").select("connection_id", "repo", "file", "symbol")
    return e.join(newest, ["repo", "file"]).where(~F.contains(F.coalesce("content", F.lit("")), F.col("symbol"))).select("connection_id")


def missing_files(nodes: DataFrame, source_files: DataFrame) -> DataFrame:
    """Components whose file is not among the scanned files of their repo: component_id, path."""
    paths = source_files.where("file is not null").select("repo", clean_path(F.col("file")).alias("path")).distinct()
    return nodes.where("file <> ''").select("component_id", "repo", clean_path(F.col("file")).alias("path")).join(paths, ["repo", "path"], "left_anti").select("component_id", "path")


def collisions(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows beyond the first of each key: counts per key without ordering a hot key's rows. keys, extra, first."""
    return rows.dropna(subset=keys).groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra"), F.min(order).alias("first")).where("extra > 0")
