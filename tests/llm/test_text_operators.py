"""Mixtures, splitting and lessons in different dress."""

import random
import unicodedata
from collections import Counter, defaultdict

import pytest

from graphloom.llm import bpe, dress, mixture, split

ENC = bpe.encoder()


def word(r):
    return "".join(r.choice("bdfklmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4)))


def prose(r, n):
    out = []
    while len(out) < n:
        out.append(" ".join(word(r) for _ in range(r.randrange(3, 12))).capitalize() + r.choice([".", "!", "?"]) + r.choice([" ", " ", "\n", "\n\n", "\n## Head\n"]))
    return "".join(out)


@pytest.mark.parametrize("limit,overlap", [(64, 8), (50, 0), (16, 15), (16, 40), (7, 2)])
def test_pieces_cover_the_text_within_the_limit(limit, overlap):
    r = random.Random(limit)
    texts = [prose(r, 60), "x" * 900, "漢字🙂" * 200, " \n" * 400, "a" + " " * 700 + "b", prose(r, 5) + "y" * 500 + prose(r, 5), "é" * 301, "\r\n\r\n".join(prose(r, 3) for _ in range(9))]
    for text in texts:
        pieces = split.split_text(text, limit, overlap, ENC)
        ids = ENC.encode(text)
        if len(ids) <= limit:
            assert pieces == []
            continue
        before_t = before_c = 0
        for i, (ts, te, cs, ce, n, _) in enumerate(pieces):
            assert n == ENC.count(text[cs:ce]) and n <= limit
            assert te > before_t and cs <= before_c < ce
            if i:
                assert before_t - ts <= min(overlap, limit - 1)
            assert ENC.decode(ids[ts:te]) == text[cs:ce]
            before_t, before_c = te, ce
        assert (before_t, before_c) == (len(ids), len(text)) and pieces[-1][5] == "end"


def test_overlap_is_exact_where_characters_allow():
    text = prose(random.Random(1), 80)
    pieces = split.split_text(text, 64, 8, ENC)
    assert {b[1] - a[0] for b, a in zip(pieces, pieces[1:])} == {8}


def test_cuts_at_natural_boundaries():
    body = "\n".join(f"## Part {i}\n" + "Some words stand here. " * 6 for i in range(8))
    pieces = split.split_text(body, 60, 0, ENC)
    assert all(body[p[2] :].startswith("## Part") for p in pieces)
    code = "\n\n".join(f"def f{i}(x):\n    y = x + {i}\n    return y * y" for i in range(20))
    assert {p[5] for p in split.split_text(code, 50, 0, ENC)} <= {"section", "paragraph", "end"}
    assert {p[5] for p in split.split_text("word " * 300, 40, 0, ENC)} <= {"word", "end"}
    assert {p[5] for p in split.split_text("z" * 2000, 40, 0, ENC)} <= {"character", "end"}


def test_a_character_of_more_tokens_than_the_limit_stays_whole():
    text = "🧬🧬🧬🧬"
    pieces = split.split_text(text, 1, 0, ENC)
    assert [text[p[2] : p[3]] for p in pieces] == list(text)


def test_split_documents_cases(spark):
    docs = [(1, "note", None), (2, "note", ""), (3, "note", "short"), (4, "note", "word " * 100), (4, "note", "word " * 100), (5, None, "word " * 100), (6, "other", "word " * 100), (7, "bad", "word " * 100)]
    df = spark.createDataFrame([(i, k, t, 9) for i, k, t in docs], "doc_id long, doc_kind string, text string, max_tokens int")
    settings = spark.createDataFrame([(2, "note", 99, 0), (1, "note", 40, None), (3, "bad", None, 1), (4, None, 5, 0)], "setting_id int, doc_kind string, max_tokens int, overlap_tokens int")
    got = split.split_documents(df, settings).collect()
    assert Counter(r["doc_id"] for r in got) == {4: 6} and {r["pieces"] for r in got} == {3}
    assert split.split_documents(df.limit(0), settings).count() == 0
    assert split.split_documents(df, settings.limit(0)).count() == 0


def mixed(spark, docs, targets, **more):
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, source string, text string, n_tokens int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return [r.asDict() for r in mixture.mixture(d, t, **more).collect()], {r["source"]: r.asDict() for r in mixture.reached_shares(d, t, **more).collect()}


def test_mixture_reaches_shares_within_caps(spark):
    r = random.Random(4)
    docs = [(i, r.choice(["big", "big", "big", "mid", "small"]), prose(r, r.randrange(1, 12))) for i in range(1200)] + [(5000, "big", None), (5001, "big", ""), (5002, None, "x"), (5003, "none", "x y z")]
    targets = [("big", 0.4, 2), ("mid", 0.35, 1), ("small", 0.25, 3), ("absent", 0.0, 1), ("zero", 0.0, 0)]
    rows, shares = mixed(spark, docs, targets)
    copies = Counter(x["doc_id"] for x in rows)
    source = {i: s for i, s, _ in docs}
    caps = {s: m for s, _, m in targets}
    assert all(n <= caps[source[i]] for i, n in copies.items())
    assert len({(x["doc_id"], x["copy_no"]) for x in rows}) == len(rows)
    tokens = defaultdict(int)
    for x in rows:
        assert x["n_tokens"] == ENC.count(x["text"])
        tokens[x["source"]] += x["n_tokens"]
    total = sum(tokens.values())
    for s, share, _ in targets[:3]:
        assert tokens[s] / total == pytest.approx(share, abs=0.005)
        assert shares[s]["reached_share"] == pytest.approx(tokens[s] / total) and shares[s]["mixed_tokens"] == tokens[s]
        spread = {n for i, n in copies.items() if source[i] == s}
        assert max(spread) - min(spread) <= 1
    assert shares["absent"]["mixed_tokens"] == 0 and 5000 not in copies and 5003 not in copies
    again, _ = mixed(spark, docs, targets)
    assert sorted((x["doc_id"], x["copy_no"]) for x in again) == sorted((x["doc_id"], x["copy_no"]) for x in rows)


def test_mixture_of_given_size_falls_short_at_the_cap(spark):
    docs = [(i, "a" if i < 10 else "b", "word " * 10) for i in range(200)]
    _, shares = mixed(spark, docs, [("a", 0.5, 2), ("b", 0.5, 2)], total_tokens=1000)
    assert shares["a"]["mixed_copies"] == 20 and shares["a"]["reached_share"] < 0.5


def test_mixture_without_documents(spark):
    rows, shares = mixed(spark, [], [("a", 1.0, 2)])
    assert rows == [] and shares["a"]["reached_share"] is None


LESSON = "seq long, category string, pattern string, signature array<string>, key string"


def brute(rows):
    fold = lambda s: None if s is None else "".join(c for c in s.upper().lower() if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")
    groups = defaultdict(list)
    for seq, c, p, s, _ in rows:
        if p is not None:
            groups[(fold(c), fold(p), tuple(sorted((fold(x) or "") if x is not None else "\0" for x in s or [])))].append(seq)
    return sorted((min(g), s) for g in groups.values() for s in g if s != min(g))


def test_lessons_in_dress(spark):
    r = random.Random(8)
    base = [("Data-Flow", "Never share the Café", ["a(b)", "c"]), ("x", "straße größe", []), (None, "p", ["a"]), ("", "p", ["a"]), ("q", "…", None), ("q", "p", [None]), ("q", "p", [""]), ("q", "a" * 5000, ["z"])]
    rows = []
    for seq in range(1, 1200):
        c, p, s = r.choice([base[0], base[0], base[0], *base])
        if r.random() < 0.5:
            p = p.upper() if r.random() < 0.5 else f" -{p} !"
        s = None if s == [] and r.random() < 0.5 else s and r.sample(s, len(s))
        rows.append((seq, c, p, s, "clash"))
    rows.append((1200, "x", None, ["a"], "k"))
    df = spark.createDataFrame(rows, LESSON)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the hot group then fills several partitions
    try:
        got = sorted(tuple(x) for x in dress.lesson_runs(df).where("first_seq <> seq").collect())
        assert got == brute(rows)
        copies = {x["first_seq"]: x["copies"] for x in dress.collapsed(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(copies.values()) == len(rows) and copies[1200] == 1
    assert dress.lesson_runs(df.limit(0)).count() == 0 and dress.collapsed(df.limit(0)).count() == 0


def test_a_run_over_many_partitions_is_one_group(spark):
    df = spark.range(1, 4001).selectExpr("case when id % 3 = 0 then concat('k', id % 7) else 'hot' end as key", "id as seq")
    got = dress.runs(df.repartition(8))
    first = {r["key"]: r["m"] for r in df.groupBy("key").agg({"seq": "min"}).withColumnRenamed("min(seq)", "m").collect()}
    rows = got.join(df, "seq").collect()
    assert len(rows) == 4000 and all(r["first_seq"] == first[r["key"]] for r in rows)
