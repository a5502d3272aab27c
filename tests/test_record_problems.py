"""Problems 3, 4 and 6 against brute force, and their defined cases."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from graphloom.operators import orphans, skew, snapshot_cells, tree_aggregate

T0 = dt.datetime(2025, 1, 1)
CONN = "seq long, connection_id string, repo string, from_id string, from_component string, to_id string, to_component string, confidence double, detected_at timestamp_ntz, arrived_at timestamp_ntz, extra string"
COMP = "seq long, component_id string, connections long, removed_at timestamp_ntz, arrived_at timestamp_ntz, name string"
SNAP = "seq long, snapshot_id string, repo string, taken_at timestamp_ntz, component_id string, version string, status string, delivered_at timestamp_ntz, value string, total long"


def day(n):
    return T0 + dt.timedelta(days=n)


def connections(spark, rows):
    full = [(i, *r, "x") for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, CONN)


def random_connections(n=2000, seed=3):
    r = random.Random(seed)
    ids = [f"C{i}" for i in range(20)]
    pick = lambda: r.choice([None, "", "HUB", "HUB", "HUB", *ids])
    return [(f"E{r.randrange(n // 2)}", r.choice(["r1", "r2", None]), pick(), pick(), pick(), pick(), r.choice([None, 0.25, 0.5, 0.875]), day(r.randrange(300)) if r.random() > 0.05 else None, day(r.randrange(300))) for _ in range(n)]


def test_target_summary_is_exact_with_a_hub(spark):
    rows = random_connections()
    got = tree_aggregate.target_summary(connections(spark, rows), chunk_rows=50, fan_in=3).collect()
    want = defaultdict(list)
    for r in rows:
        want[r[4]].append(r)
    assert len(got) == len(want)
    for g in got:
        own = want[g["to_id"]]
        conf = [r[6] for r in own if r[6] is not None]
        assert g["row_count"] == len(own)
        assert g["edges"] == len({(r[2], r[0]) for r in own})
        assert g["callers"] == len({r[2] for r in own if r[2]})
        assert g["confidence_rows"] == len(conf)
        assert g["avg_confidence"] == pytest.approx(sum(conf) / len(conf), abs=1e-6)
        assert g["last_detected"] == max(r[7] for r in own if r[7])


def test_merge_rounds():
    assert tree_aggregate.merge_rounds(40, 8) == [5, 1]
    assert tree_aggregate.merge_rounds(1, 8) == []


def test_target_summary_of_empty_and_null_confidence(spark):
    assert tree_aggregate.target_summary(connections(spark, [])).count() == 0
    one = tree_aggregate.target_summary(connections(spark, [(None, None, None, None, None, None, None, None, None)] * 2)).first()
    assert (one["to_id"], one["row_count"], one["edges"], one["callers"], one["avg_confidence"]) == (None, 2, 1, 0, None)


def test_recorded_counts(spark):
    comp = spark.createDataFrame([(1, "A", 5, None, day(1), "a"), (2, "A", 3, None, day(2), "a"), (3, "B", None, None, day(1), "b"), (4, None, 1, None, day(1), "c")], COMP)
    summary = tree_aggregate.target_summary(connections(spark, [("e1", "r", "X", None, "A", None, 0.5, day(1), day(1)), ("e2", "r", "Y", None, "A", None, 0.5, day(1), day(1))]))
    got = {r["component_id"]: (r["recorded"], r["counted"], r["difference"]) for r in tree_aggregate.counted_against_recorded(comp, summary).collect()}
    assert got == {"A": (3, 2, -1), "B": (None, 0, None)}


def brute_changes(rows):
    latest, heads = {}, {}
    for seq, snap, repo, taken, comp, version, status, delivered, *_ in rows:
        if snap is None:
            continue
        heads[snap] = (repo, taken)
        key = (snap, comp)
        rank = (delivered is not None, delivered or T0, seq)
        if key not in latest or rank > latest[key][0]:
            latest[key] = (rank, (version, status))
    by_repo, out = defaultdict(list), set()
    for snap, (repo, taken) in heads.items():
        by_repo[repo].append((taken, snap))
    for snaps in by_repo.values():
        snaps.sort()
        for (_, a), (_, b) in zip(snaps, snaps[1:]):
            before = {c: v for (s, c), (_, v) in latest.items() if s == a}
            after = {c: v for (s, c), (_, v) in latest.items() if s == b}
            out |= {(b, c, "added", "") for c in after.keys() - before.keys()} | {(b, c, "removed", "") for c in before.keys() - after.keys()}
            for c in after.keys() & before.keys():
                diff = [f for f, x, y in zip(("version", "status"), before[c], after[c]) if x != y]
                if diff:
                    out.add((b, c, "changed", ",".join(sorted(diff))))
    return out


def test_snapshot_changes_against_brute_force(spark):
    r = random.Random(5)
    rows, seq = [], 0
    for repo in ("a", "b", None):
        for k in range(4):
            snap = f"S{r.randrange(10**6)}"
            for comp in [None, *[f"C{i}" for i in range(12)]]:
                for _ in range(r.choice([0, 1, 1, 2, 3])):
                    seq += 1
                    rows.append((seq, snap, repo, day(k), comp, r.choice([None, "1", "2"]), r.choice([None, "active", "old"]), r.choice([None, day(k), day(k + 1)]), "v", 7))
    rows.append((seq + 1, None, "a", day(9), "C1", "1", "active", day(9), "v", 7))
    df = spark.createDataFrame(rows, SNAP)
    got = [tuple(x) for x in snapshot_cells.snapshot_changes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_changes(rows)


def test_snapshot_of_one_and_of_none(spark):
    one = spark.createDataFrame([(1, "S", "a", day(1), "C", "1", "active", day(1), "v", 1)], SNAP)
    assert snapshot_cells.snapshot_changes(one).count() == 0
    assert snapshot_cells.snapshot_changes(one.limit(0)).count() == 0


def test_missing_keys_match_semantics(spark):
    keys = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "z", None), (4, None, None), (5, "a", "y")], "id long, p string, q string")
    targets = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "q")], "tp string, tq string")
    ids = lambda m: sorted(r["id"] for r in orphans.missing_keys(keys, ["p", "q"], targets, ["tp", "tq"], m).collect())
    assert ids("simple") == [5]
    assert ids("partial") == [3, 5]
    assert ids("full") == [2, 3, 5]
    with pytest.raises(ValueError):
        orphans.missing_keys(keys, ["p"], targets, ["tp"], "other")


def brute_orphans(conns, comps, files):
    known, out = defaultdict(list), []
    for _, cid, _, removed, arrived, _ in comps:
        known[cid].append((removed, arrived))
    for seq, (_, repo, a, b, c, e, _, detected, arrived) in enumerate(conns, 1):
        for name, value in zip(orphans.REFERENCE_FIELDS, (a, b, c, e)):
            if not value:
                continue
            if value.startswith("FILE:"):
                if (repo, value[5:]) not in files or repo is None:
                    out.append((seq, name, "missing"))
            elif value not in known:
                out.append((seq, name, "missing"))
            else:
                removed = [x for x, _ in known[value]]
                first = min((y for _, y in known[value] if y), default=None)
                gone = max(removed) if all(removed) else None
                if gone and detected and gone <= detected:
                    out.append((seq, name, "deleted"))
                elif first and arrived and first > arrived:
                    out.append((seq, name, "late"))
    return sorted(out)


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_orphans_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(orphans, "join_lookup", lambda big, small, keys: skew.join_lookup(big, small, keys, limit=limit))
    r = random.Random(11)
    conns = []
    for row in random_connections(800, 9):
        refs = [r.choice(["FILE:src/a.ts", "FILE:src/b.ts", "FILE:", x, x, x]) for x in row[2:6]]
        conns.append((row[0], row[1], *refs, *row[6:]))
    comps = [(i, f"C{r.randrange(14)}", 0, r.choice([None, None, day(r.randrange(300))]), r.choice([None, day(r.randrange(200))]), "n") for i in range(30)] + [(99, "HUB", 0, None, day(150), "h")]
    files = {("r1", "src/a.ts"), ("r2", "src/b.ts"), (None, "src/a.ts")}
    got = orphans.orphan_references(connections(spark, conns), spark.createDataFrame(comps, COMP), spark.createDataFrame(list(files), "repo string, file string"))
    assert sorted((x["seq"], x["field_name"], x["kind"]) for x in got.collect()) == brute_orphans(conns, comps, files)


def test_orphans_of_empty_tables(spark):
    none = spark.createDataFrame([], COMP)
    files = spark.createDataFrame([], "repo string, file string")
    assert orphans.orphan_references(connections(spark, []), none, files).count() == 0
    one = connections(spark, [("e", "r", "X", None, "", "FILE:a", 0.5, None, None)])
    assert sorted((r["field_name"], r["kind"]) for r in orphans.orphan_references(one, none, files).collect()) == [("from_id", "missing"), ("to_component", "missing")]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_join_lookup_gives_the_same_rows_either_way(spark, how):
    big = spark.createDataFrame([("h" if i % 3 else f"k{i % 50}", i) for i in range(900)] + [(None, -1)], "k string, v long")
    small = spark.createDataFrame([("h", 1), *[(f"k{i}", i) for i in range(0, 50, 2)]], "k string, w long")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(skew.join_lookup(big, small, ["k"], how)) == rows(skew.join_lookup(big, small, ["k"], how, limit=0))
    assert skew.hot_keys(big, ["k"], parts=4) == [("h",)]
