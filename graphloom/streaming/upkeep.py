"""Incremental upkeep: dirty paths, drains, and upserts of the graph by micro-batches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.merge import merge_latest

LEDGER_SCHEMA = "batch_id string, marked_at timestamp, paths array<string>"


def dirty_paths(ledger: DataFrame) -> DataFrame:
    """Distinct paths of all batches of the ledger."""
    return ledger.select(F.explode("paths").alias("path")).where("path <> ''").distinct()


def drain(spark: SparkSession, ledger_path: str, checkpoint: str, handle) -> None:
    """Handles everything marked since the last drain, once: ``handle(paths, epoch)`` gets each batch's distinct paths.

    The checkpoint is the set of what was cleared: marks that arrive while a drain runs wait for the next one.
    """
    stream = spark.readStream.schema(LEDGER_SCHEMA).option("mode", "DROPMALFORMED").json(ledger_path)
    query = stream.writeStream.foreachBatch(lambda df, epoch: handle(dirty_paths(df), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: Buckets of a table by the hash of its key: what a micro-batch touches is rewritten, the rest stays.
BUCKETS = 64


class Table:
    """A parquet table in buckets of a key's hash. A change writes the buckets that it touches into a new folder; one
    small pointer file names the folder of each bucket and what has been applied, and is replaced in one step.

    All files go through the file system of the folder's path, so that it may be a shared or remote one. A lost writer
    leaves the pointer as it was; a reader that started on the version before can finish, as folders are removed only
    when two pointers in a row no longer name them. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        root = self._path(self.folder)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(root)

    def state(self) -> dict:
        """The pointer: buckets (number to folder), before (folders of the pointer before), applied (stream to last epoch)."""
        at = self._path(f"{self.folder}/_current")
        if not self._fs.exists(at):
            return {"buckets": {}, "before": [], "applied": {}}
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, schema, buckets=None) -> DataFrame:
        """The rows now (of some buckets if these are named)."""
        folders = [f for b, f in sorted(self.state()["buckets"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _point(self, state: dict) -> None:
        fresh = self._path(f"{self.folder}/_current.{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fresh, self._path(f"{self.folder}/_current"), overwrite)

    def upsert(self, batch: DataFrame, key: str, stream: str, epoch: int, order: str = "seq") -> None:
        """Applies a micro-batch of a stream, unless this stream's epoch has been applied already.

        Streams are told apart by name: epochs of another stream, or of one that was started anew, say nothing here.
        """
        state = self.state()
        if state["applied"].get(stream, -1) >= epoch:
            return
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")
        batch = batch.where(F.col(key) != "").persist()
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]
        buckets, before = dict(state["buckets"]), set(state["buckets"].values())
        if touched:
            version = f"v-{uuid.uuid4().hex}"
            merged = merge_latest(self.read(batch.schema, set(touched)), batch, key, order)
            merged.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{version}")
            buckets |= {str(b): f"{version}/__bucket={b}" for b in touched}
        batch.unpersist()
        self._point({"buckets": buckets, "before": sorted(before), "applied": state["applied"] | {stream: epoch}})
        for old in set(state["before"]) - before - set(buckets.values()):
            self._fs.delete(self._path(f"{self.folder}/{old}"), True)


def upsert_stream(stream: DataFrame, table: Table, key: str, checkpoint: str, order: str = "seq"):
    """Starts an upsert of a stream of rows into ``table``: the incoming row of a key wins, the last one if it repeats.

    A replayed micro-batch is applied once, as the table knows the last epoch of each stream. A stream is what its
    checkpoint says it is: another checkpoint, also a new one in the same place, is another stream.
    """
    spark = table.spark

    def apply(batch: DataFrame, epoch: int) -> None:
        told = spark.read.text(f"{checkpoint}/metadata").first()[0]  # {"id": "..."}, written when the checkpoint began
        table.upsert(batch, key, json.loads(told)["id"], epoch, order)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
