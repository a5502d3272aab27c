import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.operators import manifests, model_calls, reports, skew, traverse
from tests.test_graph import T, edges, ids, nodes


def test_numbering_without_a_window_over_a_hot_key(spark):
    rows = [("hot", i % 7, i) for i in range(500)] + [("a", 1, 1), ("a", 0, 2), (None, 1, 3)]
    df = spark.createDataFrame(rows, "k string, v int, id long").repartition(5)
    got = {(r["k"], r["id"]): r["position"] for r in skew.numbered(df, ["k"], [F.desc("v"), "id"]).collect()}
    want = {("hot", i): p for p, i in enumerate((i for _, i in sorted((-(i % 7), i) for i in range(500))), 1)} | {("a", 1): 1, ("a", 2): 2}
    assert got == want
    assert skew.numbered(df.limit(0), ["k"], ["id"]).count() == 0


def test_rollup_and_top_rows(spark):
    labels = spark.createDataFrame([(f"n{i}", "x" if i < 8 else "y") for i in range(10)] + [("z", None)], "component_id string, community string")
    ranks = spark.createDataFrame([(f"n{i}", 0.1 * (i % 4)) for i in range(9)], "component_id string, rank double")
    got = {r["community"]: (r["members"], r["rank"], r["best"]) for r in reports.community_rollup(labels.dropna(), ranks, 3).collect()}
    assert got == {"x": (8, 1.2, "n3,n7,n2"), "y": (2, 0.0, "n8,n9")}


def test_premerge_diff(spark):
    row = lambda s, c, v="1", st="active", at=0, seq=1: (s, "r", c, v, st, "l", True, "npm", T + dt.timedelta(hours=at), seq, T)
    snaps = spark.createDataFrame([row("s1", "a"), row("s1", "b"), row("s1", "c"), row("s2", "a"), row("s2", "b", "2"), row("s2", "d"), row("s2", "b", "3", at=1), row("s3", "e")], "snapshot_id string, repo string, component_id string, version string, status string, layer string, critical boolean, component_type string, delivered_at timestamp, seq long, taken_at timestamp")
    base = spark.createDataFrame([("r", "s1")], "repo string, snapshot_id string")
    branch = spark.createDataFrame([("r", "s2"), ("q", "s3")], "repo string, snapshot_id string")
    assert {tuple(r) for r in reports.premerge_diff(snaps, base, branch).collect()} == {("r", True, 1, 1, 1), ("q", False, None, None, None)}


def test_globs(spark):
    paths = {"src/**/x.ts": (["src/x.ts", "src/a/b/x.ts"], ["srcx.ts", "src/ax.ts"]), "**/test": (["test", "a/test"], ["mytest"]), "a?c/*.py": (["abc/x.py"], ["a/c/x.py", "abc/d/x.py"]), "a+b(1).ts": (["a+b(1).ts"], ["aab1.ts"]), "lib/**": (["lib/a/b"], ["libs/a"])}
    import re

    for glob, (hits, misses) in paths.items():
        assert [bool(re.search(reports.glob_pattern(glob), p)) for p in hits + misses] == [True] * len(hits) + [False] * len(misses)
    with pytest.raises(ValueError):
        reports.glob_pattern("**/" * 9)
    n = nodes(spark, ("a", "component", None, "src/gen/a.ts"), ("b", "component", None, "x/vendor/b.ts"), ("c", "component", None, "packages/react/c.js"), ("d", "component", None, None), ("react", "npm", None, None))
    assert dict(ids(reports.mappable(n, ["src/gen/**"]), "component_id", "verdict")) == {"a": "excluded", "b": "vendored", "c": "suspect", "d": "kept"}


def test_plans_and_remaps(spark):
    lots = spark.createDataFrame([("a", 100, None, False, 0), ("b", 100, None, False, 3), ("c", 100, None, True, 9), ("d", 3, "AQL", True, 9), ("e", 100, "Cochran", None, None)], "repo string, lot long, plan string, breach boolean, prior long")
    assert {tuple(r) for r in reports.plan_choice(lots).collect()} == {("a", "AQL", 20, 1), ("b", "SPRT", 20, 1), ("c", "Cochran", 43, 0), ("d", "AQL", 2, 0), ("e", "Cochran", 43, 0)}
    e = edges(spark, ("old1", "old2"), ("old1", "FILE:x"), ("gone", "same"), (None, "old2"))
    prior = spark.createDataFrame([("old1", "S1"), ("old2", "S2"), ("gone", "S9"), ("same", "S3"), ("x", None)], "component_id string, stable_id string")
    now = spark.createDataFrame([("new1", "S1"), ("new2", "S2"), ("new2b", "S2"), ("same", "S3"), ("y", None)], "component_id string, stable_id string")
    assert ids(reports.remap_ids(e, prior, now), "connection_id", "from_id", "to_id", "remapped") == [("E1", "new1", "new2", 2), ("E2", "new1", "FILE:x", 1), ("E3", "gone", "same", 0), ("E4", None, "new2", 1)]


def test_env_usage_and_hosting(spark):
    rows = spark.createDataFrame([("export DB_URL=postgres://x\n  API_KEY = 'k'\n# NOPE=1\nlower=2",), ("DB_URL=2",), ("if (A_B==1) process.env.PORT",), (None,)], "code string")
    refs = spark.createDataFrame([("DB_URL", 4), ("PORT", 1)], "name string, rows long")
    assert ids(reports.env_usage(rows, "code", refs), "name", "category", "defined", "referenced", "state") == [("API_KEY", "api-key", 1, 0, "unused"), ("DB_URL", "database", 2, 4, "used"), ("PORT", "infra", 0, 1, "undefined")]
    n = nodes(spark, ("h", "infra", "infra", None, {"name": "Railway"}), ("r", "database", "database", None, {"name": "Redis cache"}), ("s", "npm", "backend", None, {"name": "redis"}), ("o", "database", "database", None, {"name": "redis", "repo": "other"}))
    assert ids(reports.hosting(n), "host_id", "component_id") == [("h", "r")]


def test_declared_entries_lead_to_source(spark):
    pkg = '{"main": "dist/cli/index.js", "bin": {"x": "./bin/x.js"}, "exports": {".": {"types": "./dist/t.d.ts", "import": "./dist/lib.mjs"}, "./a": ["./build/a.js"]}, "scripts": {"mcp": "node dist/mcp/server.js --port=1", "t": "vitest"}, "files": ["web/server.cjs", "dist", "../no.js", "*.js"]}'
    files = spark.createDataFrame([("r", "package.json", pkg), ("r", "web\\package.json", '{"main": "lib/w.js", "bin": "cli.js"}'), ("r", "x/package.json", "no json"), ("r", "y/package.json", None), ("r", "package.json.bak", pkg)], "repo string, file string, content string")
    got = {r["path"]: r["source"] for r in manifests.declared_entries(files).collect()}
    for path, source in {"src/cli/index.ts": "package-entry", "bin/x.js": "package-entry", "src/lib.mts": "package-entry", "src/a.ts": "package-entry", "src/mcp/server.ts": "package-script", "web/server.cjs": "package-file", "web/src/w.ts": "package-entry", "web/cli.ts": "package-entry"}.items():
        assert got.get(path) == source, path
    assert not any("t.d" in p or "no.js" in p or "*" in p or p.startswith("x/") for p in got)
    n = nodes(spark, ("c", "component", "backend", "./src/mcp/server.ts", {"name": "x"}))
    assert ids(traverse.entry_points(n, manifests.declared_entries(files)), "id", "reason") == [("c", "package-script")]
    assert manifests.declared_entries(files.limit(0)).count() == 0


def test_cargo_and_schema(spark):
    cargo = '[package]\nname = "x"\nversion = "9"\n\n[dependencies]\nserde = "1.0"\ntokio = { features = ["rt"], version = "1.2" }\nlocal = { path = "../l" }\n\n[dev-dependencies.rand]\nversion = "0.8"\n[features]\na = "b"\n'
    files = spark.createDataFrame([("r", "crates/x/Cargo.toml", cargo), ("r", "Cargo.toml", None)], "repo string, file string, content string")
    assert ids(manifests.cargo_dependencies(files).fillna("-"), "section", "name", "version") == [("dependencies", "local", "-"), ("dependencies", "serde", "1.0"), ("dependencies", "tokio", "1.2"), ("dev-dependencies", "rand", "0.8")]
    schema = 'datasource db { provider = "postgresql" }\nmodel User {\n  id Int @id\n  email String? @unique // mail\n  posts Post[]\n  // not a field\n  org Org @relation(fields: [orgId], references: [id])\n  orgId Int\n  @@map("users")\n  @@index([orgId])\n}\n'
    files = spark.createDataFrame([("r", "prisma/schema.prisma", schema), ("r", "a.ts", schema)], "repo string, file string, content string")
    rows = manifests.schema_models(files).collect()
    assert {(r["field"], r["field_type"], r["is_array"], r["is_optional"], r["is_id"], r["is_unique"], r["relation"]) for r in rows} == {
        ("id", "Int", False, False, True, False, None), ("email", "String", False, True, False, True, None), ("posts", "Post", True, False, False, False, "Post"), ("org", "Org", False, False, False, False, "Org"), ("orgId", "Int", False, False, False, False, None),
    }
    assert {(r["model"], r["table_name"]) for r in rows} == {("User", "users")}


def test_traced_model_calls(spark):
    """Clients, default imports, functions and imports that stand in for clients; what is called on something else is none."""
    files = [
        ("src/a.ts", "import OpenAI from 'openai'\nconst ai: OpenAI = new OpenAI({})\nconst r = await ai.chat.completions.create({\n  model: 'gpt-4o',\n  messages: [{ role: 'user', content: 'Hi' }],\n  temperature: 0.2,\n})\nother.chat.completions.create({})\nai.embeddings.create({ model: 'e' })"),
        ("src/b.ts", "import ollama from 'ollama'\nollama.chat({ model: 'llama3' })\nsocket.chat('x')"),
        ("src/c.ts", "import { generateText } from 'ai'\nawait generateText({ model: openai('gpt-4o'), prompt: `x`, maxTokens: 9 })\nx.generateText(1)"),
        ("src/d.ts", "const { BedrockRuntimeClient } = require('@aws-sdk/client-bedrock-runtime')\nthis.rt = new BedrockRuntimeClient({})\nthis.rt.send( new ConverseCommand({ modelId }))"),
        ("src/e.py", "client = Anthropic()\nclient.messages.create(model='c')"), ("src/f.ts", "import { ChatOpenAI } from '@langchain/openai'\nchain.invoke({ input })"), ("src/g.ts", "const c = new Anthropic()\nc.beta.messages.create({ max_tokens: 5 })"),
        ("src/__tests__/h.ts", "const c = new Anthropic()\nc.messages.create({})"), ("src/i.ts", None), ("src/j.ts", ""), ("src/k.ts", "generateText({})"),
    ]
    df = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(files)], "file_id long, file string, content string")
    got = {tuple(r) for r in model_calls.traced_calls(df).collect()}
    assert got == {
        (0, 3, "openai", "chat.completions.create", "chat", "ai", "gpt-4o", 0.2, None, 1.0), (0, 9, "openai", "embeddings.create", "embedding", "ai", "e", None, None, 0.85), (1, 2, "ollama", "chat", "chat", "ollama", "llama3", None, None, 0.85),
        (2, 2, "vercel-ai-sdk", "generateText", "completion", None, "gpt-4o", None, 9, 1.0), (3, 3, "bedrock", "send(new ConverseCommand", "chat", "rt", None, None, None, 0.75), (5, 2, "langchain", "invoke", "chat", "chain", None, None, None, 0.75),
        (6, 2, "anthropic", "beta.messages.create", "chat", "c", None, None, 5, 0.65),
    }
    assert model_calls.traced_calls(df.limit(0)).count() == 0
    sites = model_calls.call_sites(df, "file_id", "content")
    assert {tuple(r) for r in sites.collect()} == {(4, 2, "anthropic-messages", "anthropic")}


def test_cuts_are_freed(spark, monkeypatch):
    from pathlib import Path

    from graphloom import session

    monkeypatch.setattr(session, "_written", [])
    one, two = session.cut(spark.range(3).toDF("id")), session.cut(spark.range(2).toDF("id"))
    assert one.count() + two.count() == 5
    session.drop_cut(one)
    paths = [Path(x.cut_path.removeprefix("file:")) for x in (one, two)]
    assert not paths[0].exists() and paths[1].exists()
    assert session.free_cuts() == 1 and not paths[1].exists() and session.free_cuts() == 0
