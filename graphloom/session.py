"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the operators are tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def let_workers_import(spark: SparkSession) -> None:
    """Puts this package's folder on the path of Python workers.

    That serves local masters and clusters that see the folder under the same path; elsewhere ship it with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a data directory; columns are pruned at the scan by the caller's plan."""
    let_workers_import(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names its shared folder in ``spark.checkpoint.dir``. A temporary folder of this machine
    is used only when nothing is set and the master is local.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there, whatever executor is lost.

    Unlike a checkpoint it is computed once; partitions are those of the written files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Removes the files of a ``cut`` that nothing reads any more, so that a long loop holds two rounds on disk, not all."""
    spark = df.sparkSession
    _remove(spark, df.cut_path)
    _written.remove((spark, df.cut_path))


def free_cuts() -> int:
    """Removes the files of all ``cut`` tables and gives their number: for a long session, once the results that read
    them have been written. Without it they stay until the process ends."""
    n = len(_written)
    while _written:
        _remove(*_written.pop())
    return n


def cut_in_place(df: DataFrame) -> DataFrame:
    """A reliable checkpoint that keeps the partitions and their order."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; its folder is the cluster's to clean
            return


def spread(df: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, by ``keys`` (unique ones): for costly work per row on
    input that lies in few row groups. Rows stay as they are where there are enough partitions.

    ``of`` is the scan whose partitions are counted; name it where ``df`` is more than a scan, as counting the partitions
    of a join would run the stages before it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if (df if of is None else of).rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
