import json

from graphloom.operators import deepmap


def test_ingest_reasons_in_order(spark):
    good = {"component_id": "a", "kind": "risk", "text": "x" * 900, "evidence": ["src/a.ts:3", "", "y" * 500], "confidence": 7.0}
    cases = [good, {**good, "component_id": "zz"}, {**good, "component_id": "b"}, {**good, "kind": "poem"}, {**good, "text": " "}, {**good, "evidence": []}, {**good, "evidence": ["src/none.ts"]}, {**good, "confidence": None}]
    results = spark.createDataFrame([("p", json.dumps(cases)), ("q", "no json"), ("r", json.dumps([{**good, "component_id": "b"}] * 41))], "packet_id string, json string")
    packets = spark.createDataFrame([("p", 1, ["a"]), ("q", 1, ["a"]), ("r", 3, ["a"])], "packet_id string, tier int, component_ids array<string>")
    nodes = spark.createDataFrame([("a",), ("b",)], "component_id string")
    files = spark.createDataFrame([("src/a.ts",), (None,)], "file string")
    rows = deepmap.ingest(results, packets, nodes, files).collect()
    p = {r["position"]: r for r in rows if r["packet_id"] == "p"}
    assert [p[i]["rejection"] for i in range(8)] == [None, "unknown_component", "unknown_component", "schema_violation", "schema_violation", "missing_evidence", "missing_evidence", None]
    assert len(p[0]["text"]) == 600 and [len(e) for e in p[0]["evidence"]] == [10, 200] and p[0]["confidence"] == 1.0 and p[7]["confidence"] == 0.5
    assert [r["rejection"] for r in rows if r["packet_id"] == "q"] == ["unreadable"]
    r = [x["rejection"] for x in rows if x["packet_id"] == "r"]
    assert r.count(None) == 40 and r.count("over_limit") == 1
