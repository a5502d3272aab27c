"""Finding repositories, stacks and source files on a file system (driver-side listing of names only)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Manifests that mark a stack, and folders that are not entered.
MANIFESTS = {"package.json": "npm", "pyproject.toml": "pip", "requirements.txt": "pip", "Cargo.toml": "cargo", "Package.swift": "spm", "Podfile": "pods"}
PRUNED = {"node_modules", ".git", "dist", "build", "target", ".venv", "venv", "__pycache__", "Pods"}


def stack_roots(spark: SparkSession, root: str, depth: int = 3) -> DataFrame:
    """Folders below ``root`` that hold a manifest, down to ``depth``: path (relative), manifest, stack."""
    found = []
    for folder, names, files in os.walk(root):
        level = os.path.relpath(folder, root).count(os.sep) + (folder != root)
        names[:] = sorted(n for n in names if n not in PRUNED and not n.startswith(".")) if level < depth else []
        found += [(os.path.relpath(folder, root), f, MANIFESTS[f]) for f in sorted(files) if f in MANIFESTS]
    return spark.createDataFrame(found, "path string, manifest string, stack string")


def repositories(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """Folders with a .git entry below ``root`` (depth 1 to 3, symbolic links skipped): path."""
    depth, found = max(1, min(3, depth)), []
    for folder, names, _ in os.walk(root):
        level = os.path.relpath(folder, root).count(os.sep) + (folder != root)
        if folder != root and os.path.exists(os.path.join(folder, ".git")):
            found.append((os.path.relpath(folder, root),))
            names[:] = []
            continue
        names[:] = sorted(n for n in names if n not in PRUNED and not os.path.islink(os.path.join(folder, n))) if level < depth else []
    return spark.createDataFrame(found, "path string")


def read_sources(spark: SparkSession, root: str, pattern: str = "*.{ts,tsx,js,jsx,py,rs,swift,css,md}") -> DataFrame:
    """Files below ``root`` as rows: path, content, size_bytes, hash (SHA-256), modified_at. Read by executors."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return raw.select(F.col("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("modified_at"))
