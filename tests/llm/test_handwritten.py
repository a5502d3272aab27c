import random

from graphloom.llm import handwritten as h

HAND = "import { a } from './b';\n\n// Adds up what is due.\nexport function total(rows) {\n  let sum = 0;\n  for (const row of rows) {\n    if (!row.paid) sum += row.due;\n  }\n  return sum;\n}\n"


def verdict(text, lang="javascript"):
    return h.machine_layout(h.layout(text), len(h._words(text)), lang)


def test_layouts():
    r = random.Random(1)
    minified = "".join(f"function a{i}(b,c){{return b?c(b):d[{i}]}}" for i in range(60))
    assert verdict(minified) == "minified"
    assert verdict(".a{color:#fff;margin:0}.b{color:#000;padding:1px}" * 30, "css") == "minified"
    numbers = "const t = [\n" + "\n".join("  " + ", ".join(str(r.randrange(999)) for _ in range(16)) + "," for _ in range(20)) + "\n];\n"
    assert verdict(numbers) == "table"
    blob = "export const b = [" + ",\n ".join("0x%02x" % r.randrange(256) for _ in range(400)) + "];"
    assert verdict(blob) in ("encoded", "minified")
    words = "NAMES = [" + ", ".join(f'"{"".join(r.choice("abcdef") for _ in range(6))}"' for _ in range(120)) + "]"
    assert verdict(words, "python") in ("data", "minified", "marks")
    states = "\n".join(f"case {i}: __s = {i * 7}; __a = __a ^ 0x{i:04x}; break;" for i in range(40))
    assert verdict(states, None) == "repeated"
    assert verdict(HAND) is None and verdict(HAND * 5) is None and verdict("") is None
    table = "// limits agreed with the owners, keep them sorted by hand\nconst LIMITS = {\n" + "".join(f"  'queue-{i}': {i * 10},  // agreed in spring with the team of service {i}\n" for i in range(30)) + "};\n"
    assert verdict(table) is None


def test_origins():
    generated = ["// Code generated by protoc. DO NOT EDIT.", "/* <auto-generated/> */", "# Diese Datei wurde von xgen erzeugt. Bitte nicht von Hand ändern.", "// Fichier créé automatiquement par x, ne pas modifier", "/**\n * @generated by y\n */"]
    assert [h.stated_origin(x + "\n" + HAND) for x in generated] == ["generated"] * 5
    other = ["/*!\n * lib v1.2.3\n * (c) the lib contributors\n * Released under the MIT License.\n */", "/** @license lib 1.2.3 - Apache-2.0 - https://lib.example */", "// lib 3.6.11, copied from the upstream release archive, licence BSD-3-Clause"]
    assert [h.stated_origin(x + "\n" + HAND) for x in other] == ["other_project"] * 3
    own = ["// Fails the build when a file lacks its 'do not edit' line.", "// First scaffolded by a tool, since then written and maintained by hand.", "// Copyright the team behind this repository, all rights reserved", "// vendor = a seller", "const x = '@generated';", ""]
    assert [h.stated_origin(x + "\n" + HAND) for x in own] == [None] * 6
    assert h.stated_origin(HAND + "// Code generated by x. DO NOT EDIT.") is None


def test_origins_after_blank_lines_and_long_licences():
    licence = "".join(f"// Line {i} of a licence text that goes on.\n" for i in range(150))
    mark = "// Code generated by protoc-gen-go. DO NOT EDIT.\n"
    heads = ["// Copyright the team.\n\n" + mark, "#!/usr/bin/env node\n\n/* made\n by a tool: do not edit */\n", licence + mark, licence + "\n \n" + mark, "/*" + licence.replace("//", " *") + "*/\n\n" + mark, "-- a\n\n; b\n\n<!-- c -->\n\n# Generated by x\n"]
    assert [h.stated_origin(x + "\n" + HAND) for x in heads] == ["generated"] * 6
    assert h.stated_origin(licence + "\n// lib 3.6.11, copied from the upstream release archive, licence BSD-3-Clause\n" + HAND) == "other_project"
    assert h.stated_origin("// ours\n\n" + HAND + "\n" + mark) is None
    assert h.stated_origin("// a\n\n" * 20000 + HAND) is None


def test_copies_of_packages():
    r = random.Random(3)
    lib = "\n".join(f"export function {''.join(r.choice('abcdefgh') for _ in range(7))}(x) {{ return x + {r.randrange(999)}; }}" for _ in range(30))
    index = h.PackageIndex([(7, lib), (8, HAND * 3)])
    altered = "// mine now\n" + "\n".join(line for i, line in enumerate(lib.split("\n")) if i % 9).replace("  ", " ").replace("\n", "\r\n")
    assert index.copy_of(lib) == (7, 1.0) and index.copy_of(altered)[0] == 7
    assert index.copy_of(HAND) == (8, 1.0) or index.copy_of(HAND)[0] in (8, None)
    assert index.copy_of("short text")[0] is None and index.copy_of("")[0] is None


def test_small_files():
    """No size hides a file: short packed code, short blobs, short tables, and copies of short package files."""
    assert verdict("!function(a){var b={};function c(d){if(b[d])return b[d].x;var e=b[d]={x:{}};return a[d](e,e.x,c),e.x}c(0)}([function(a,b){b.y=1}]);") == "minified"
    assert verdict('k = "' + "QUJD" * 20 + '"', "python") == "encoded"
    assert verdict("[3, 14, 15, 92, 65, 35, 89, 79, 32, 38, 46, 26, 43]") == "table"
    index = h.PackageIndex([(4, "module.exports = require('./lib/index');"), (5, "'use strict';")])
    assert index.copy_of("module.exports  =\n require('./lib/index')") == (4, 1.0)
    assert index.copy_of("module.exports = require('./lib/other')")[0] is None and index.copy_of("'use strict'")[0] is None


def test_rows_and_blocks(spark, monkeypatch):
    r = random.Random(5)
    libs = ["\n".join(f"def {''.join(r.choice('klmnop') for _ in range(8))}(v): return v * {r.randrange(999)}" for _ in range(25)) for _ in range(4)]
    files = [(1, "a", "javascript", HAND), (2, "a", "python", libs[0]), (3, "a", None, libs[3] + "\n# end"), (4, "b", "python", None), (5, "b", "python", ""), (6, None, "css", ".a{b:c}" * 90), (6, None, "css", ".a{b:c}" * 90)]
    df = spark.createDataFrame([(*x, "clash") for x in files], "file_id long, repo string, code_lang string, content string, layout string")
    packages = spark.createDataFrame(list(enumerate(libs)), "item_id int, content string")
    for block in (1 << 25, 10):
        monkeypatch.setattr(h, "PACKAGE_BLOCK_CHARS", block)
        source = df if block > 10 else df.dropDuplicates(["file_id"])
        got = {x["file_id"]: (x["machine_made"], x["package_item"]) for x in h.file_evidence(source, packages).collect()}
        assert got == {1: (False, None), 2: (True, 0), 3: (True, 3), 4: (False, None), 5: (False, None), 6: (True, None)}
    assert h.file_evidence(df, packages).count() == 7
    assert h.file_evidence(df.limit(0), packages).count() == 0
    assert h.file_evidence(df, packages.limit(0)).where("package_item is not null").count() == 0
