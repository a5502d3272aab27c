import datetime as dt
import json

from pyspark.sql import functions as F

from graphloom.operators import audit
from graphloom.streaming import journal, upkeep

T = dt.datetime(2025, 1, 1)


def _write(path, rows, torn=False):
    text = "\n".join(json.dumps(r) for r in rows)
    path.write_text(text + ('\n{"ts": "2025-01-0' if torn else "\n"))


def _records():
    ops = ["project.registered", "project.scanned", "architecture.changed", "project.scanned", "project.removed", "project.scanned"]
    return [{"ts": f"2025-01-0{i + 1}T00:00:00Z", "op": op, "slug": slug, "actor": "cli"} for slug in ("a", "b") for i, op in enumerate(ops[: 6 if slug == "a" else 5])]


def test_stream_fold_equals_batch(spark, tmp_path):
    folder = tmp_path / "journal"
    folder.mkdir()
    rows = _records()
    _write(folder / "1.jsonl", rows[:4])
    _write(folder / "2.jsonl", rows[4:], torn=True)
    batch = {r["slug"]: (r["scans"], r["changes"], r["status"]) for r in journal.fold_batch(journal.read_journal_once(spark, str(folder))).collect()}
    assert batch == {"a": (3, 1, "active"), "b": (2, 1, "removed")}
    stream = journal.fold_stream(journal.read_journal(spark, str(folder), files_per_trigger=1))
    q = stream.writeStream.outputMode("update").format("memory").queryName("fold").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("fold").groupBy("slug").agg(F.max_by(F.struct("scans", "changes", "status"), "scans").alias("r"))
    assert {r["slug"]: tuple(r["r"]) for r in last.collect()} == batch


def test_tail_filters_before_it_limits(spark, tmp_path):
    _write(tmp_path / "1.jsonl", _records())
    got = journal.tail(journal.read_journal_once(spark, str(tmp_path)), 2, op="project.scanned").collect()
    assert [r["ts"].day for r in got] == [4, 6]


def test_drift_stream_equals_batch(spark, tmp_path):
    values = [0.1, 0.12, 0.11, 0.09, 0.1, 0.1, 0.5, 0.6, 0.11]
    rows = [{"stratum": "s", "at": i, "rate": v} for i, v in enumerate(values)]
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "1.jsonl", rows[:6])
    _write(tmp_path / "in" / "2.jsonl", rows[6:])
    schema = "stratum string, at long, rate double"
    expected = audit.ewma(spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], schema), "stratum", "at", "rate").orderBy("n").collect()
    s = journal.drift_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    q = s.writeStream.outputMode("append").format("memory").queryName("drift").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("drift").orderBy("n").collect()
    assert [round(r["z"], 9) for r in got] == [r["z"] for r in expected]
    assert [r["breach"] for r in got] == [r["breach"] for r in expected] and any(r["breach"] for r in got)


def test_drain_clears_what_it_saw_only(spark, tmp_path):
    ledger, seen = tmp_path / "ledger", []
    ledger.mkdir()
    _write(ledger / "1.json", [{"batch_id": "1", "paths": ["a", "b"]}])
    run = lambda: upkeep.drain(spark, str(ledger), str(tmp_path / "cp"), lambda df, e: seen.append(sorted(r["path"] for r in df.collect())))
    run()
    _write(ledger / "2.json", [{"batch_id": "2", "paths": ["b", "c", ""]}])
    run()
    run()
    assert seen == [["a", "b"], ["b", "c"]]


def test_upsert_stream_keeps_the_last_row(spark, tmp_path):
    schema = "id string, v long, seq long"
    inbox = tmp_path / "in"
    inbox.mkdir()
    table = upkeep.Table(spark, str(tmp_path / "table"))
    for i, rows in enumerate([[("a", 1, 1), ("b", 1, 2)], [("a", 2, 1), ("a", 3, 5), ("c", 1, 3), (None, 9, 9)]]):
        _write(inbox / f"{i}.json", [dict(zip(("id", "v", "seq"), r)) for r in rows])
        stream = spark.readStream.schema(schema).json(str(inbox))
        upkeep.upsert_stream(stream, table, "id", str(tmp_path / "cp")).awaitTermination()
    assert {r["id"]: r["v"] for r in table.read(spark.createDataFrame([], schema).schema).collect()} == {"a": 3, "b": 1, "c": 1}


def test_streams_with_equal_epochs_are_all_applied(spark, tmp_path):
    """A second stream with a checkpoint of its own begins at epoch 0 again; a replayed epoch changes nothing."""
    schema = "id string, v long, seq long"
    table = upkeep.Table(spark, str(tmp_path / "table"))
    for i, rows in enumerate([[("a", 1, 1)], [("b", 2, 1)], [("c", 3, 1)]]):
        inbox = tmp_path / f"in{i}"
        inbox.mkdir()
        _write(inbox / "1.json", [dict(zip(("id", "v", "seq"), r)) for r in rows])
        upkeep.upsert_stream(spark.readStream.schema(schema).json(str(inbox)), table, "id", str(tmp_path / f"cp{i}")).awaitTermination()
    now = lambda: {r["id"]: r["v"] for r in table.read(spark.createDataFrame([], schema).schema).collect()}
    assert now() == {"a": 1, "b": 2, "c": 3} and len(table.state()["applied"]) == 3
    table.upsert(spark.createDataFrame([("a", 9, 9)], schema), "id", "s", 0)
    table.upsert(spark.createDataFrame([("a", 7, 9)], schema), "id", "s", 0)
    assert now() == {"a": 9, "b": 2, "c": 3}
    for epoch in range(1, 5):
        table.upsert(spark.createDataFrame([("a", epoch, 9)], schema), "id", "s", epoch)
    assert now()["a"] == 4
    versions = [x for x in (tmp_path / "table").iterdir() if x.name.startswith("v-") and list(x.glob("__bucket=*"))]
    assert len(versions) <= 5


def test_windows_with_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "1.json", [{"ts": f"2025-01-01T0{h}:10:00Z", "event_type": "view"} for h in (0, 0, 1)])
    _write(tmp_path / "in" / "2.json", [{"ts": "2025-01-01T09:00:00Z", "event_type": "view"}])
    s = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = journal.windowed(s).writeStream.outputMode("append").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["start"].hour, r["events"]) for r in spark.table("win").orderBy("start").collect()] == [(0, 2), (1, 1)]
