from __future__ import annotations

import random

import pytest

from custodia.llm.handwritten import accessor_pairs, containment, function_names, leading_comments, line_hashes, numbered, reasons_of, unwritten_files


@pytest.mark.parametrize(
    "head",
    ["# Code generated by schemac v1.2. DO NOT EDIT.", "// @generated by tablesmith 3.1", "/*\n * <auto-generated> apigen 2 </auto-generated>\n */", "// Automatisch erzeugt mit Formwerk 1.0 - nicht bearbeiten", "# 此文件由 stubmill 4.13 自动生成，请勿手动修改", "// Fichier produit par gabarit 0.2, ne pas modifier", "// This file was produced by modelwright 2.22; local changes will be lost.", "<?php\n// Autogenerated, do not modify by hand (stubmill 0.1)"],
)
def test_marks_of_generators(head):
    assert reasons_of("src/a.x", head + "\nx = 1\n", "own") == ["generated"]


@pytest.mark.parametrize(
    "text",
    [
        "// Writes the banner of every generated client; the text below ends up in the output, not here.\nexport const BANNER = \"DO NOT EDIT, generated by \";\n",
        "class A {\n  /** Auto-generated method stub */\n  f() {}\n}\n",
        "# (c) Own Data, internal use\n# Maintained by hand by the catalog desk\ndef f():\n    pass\n",
        "LIMITS = {\n" + "".join(f'  "k{k}": {k},\n' for k in range(20)) + "}\n\n" + "".join(f"def work_{k}(a, b):\n    total = combine(a, b, store)\n    return total.finish(report) or None\n\n" for k in range(12)),
        "",
        "// placeholder\n",
    ],
)
def test_written_by_hand(text):
    assert reasons_of("src/generator_minify/vendor_portal.js", text, "own") == []


def test_composition():
    accessors = "".join(f"def get_{n}(self):\n    return self.x\n\ndef set_{n}(self, v):\n    self.x = v\n\n" for n in ("order", "ledger", "batch"))
    assert accessor_pairs(function_names(accessors)) == 6 == len(function_names(accessors))
    steps = "".join(f"  async state{k:04}Shift(a, b) {{\n    return a + b\n  }}\n\n" for k in range(9))
    assert numbered(function_names(steps)) == 9
    assert reasons_of("a.js", "export class A {\n" + steps + "}\n", "own") == ["generated"]
    assert reasons_of("a.py", "".join(f"def case_{w}(a):\n    return a\n\n" for w in "abcdefghij") + "def v2(a):\n    return a\n", "own") == []
    assert reasons_of("a.py", accessors, "own") == ["generated"]
    assert reasons_of("a.js", "!function(e,t){" + "".join(f"var a{k}=e.b{k}||{{}};if(!t)throw new Error(\"x y z\");" for k in range(30)) + "}(this);\n", "own") == ["minified"]
    assert reasons_of("a.py", "X = [\n" + "  123, 456, 789, 123, 456,\n" * 40 + "]\n", "own") == ["data"]
    assert reasons_of("a.go", 'package a\n\nvar b = []string{\n' + '\t"pL6SX6TjQFxRd/6TsHv0uhjDtzdeiSfWyogK4q17qQYLsf6bezhW2",\n' * 20 + "}\n", "own") == ["data"]
    assert reasons_of("lib/a.js", "/*\n * (c) the plaingrid contributors, released under the Open Fold terms\n */\nf()\n", "own") == ["vendored"]
    assert reasons_of("node_modules/a/b.js", "f()\n", "own") == ["vendored"]
    assert leading_comments("<?php\n/* a\n b */\nnamespace X;\n// c\nf();\n// d\n") == ["<?php", "/* a", " b */", "// c"]


def test_copies_across_repositories_with_edits(spark):
    random.seed(6)
    line = lambda: "    " + " ".join(random.choice("alpha beta gamma delta kappa omega".split()) + str(random.randint(0, 99)) for _ in range(5))
    library = [line() for _ in range(60)]
    edited = library[:30] + [line(), line()] + library[30:]
    rows = [(k, f"repo{k}", "src/a.py", "\n".join(library)) for k in range(40)]
    rows += [(50, "other", "src/b.py", "\n".join(edited)), (51, "repo1", "src/c.py", "\n".join(line() for _ in range(40))), (52, "alone", "x.py", "\n".join(library[:6] + [line() for _ in range(40)]))]
    own = "\n".join(line() for _ in range(30))
    rows += [(60, "same", "a.py", own), (61, "same", "b.py", own), (62, None, None, ""), (63, "r", "p", None), (None, "r", "p", "x"), (60, "same", "a.py", own)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file_id long, repo string, path string, content string, hash int")
    found = {(r["file_id"], r["reason"]) for r in unwritten_files(df, "file_id", "repo", "path", "content").collect()}
    assert found == {(k, "copied") for k in range(40)} | {(50, "copied")}
    counts = {r["file_id"]: (r["lines"], r["holds"]) for r in containment(df, "file_id", "repo", "path", "content").collect()}
    assert counts[0] == (58, 58) and counts[60] == (28, 0) and counts[50][0] == 60 and 54 <= counts[50][1] < 60
    assert len(line_hashes("a\nb\nc\n")) == 0
    assert unwritten_files(df.limit(0), "file_id", "repo", "path", "content").collect() == []


def test_notices_behind_a_long_head_are_read():
    licence = "".join(f"// line {k} of the header\n" for k in range(30))
    assert reasons_of("a.go", licence + "// Code generated by schemac v1.2. DO NOT EDIT.\npackage a\n", "own") == ["generated"]
    block = "/*\n" + "".join(f"  line {k} of the header\n" for k in range(100)) + "  (c) the plaingrid contributors, released under the Open Fold terms\n*/\nf()\n"
    assert reasons_of("lib/a.js", block, "own") == ["vendored"]
    assert reasons_of("lib/a.js", licence + "f()\n// Code generated by schemac v1.2. DO NOT EDIT.\n", "own") == []


def test_containment_is_that_in_one_other_repository(spark):
    random.seed(7)
    line = lambda: "    " + " ".join(random.choice("alpha beta gamma delta kappa omega".split()) + str(random.randint(0, 999)) for _ in range(5))
    blocks = [[line() for _ in range(12)] for _ in range(6)]
    scattered = [x for b in blocks for x in b]
    rows = [(1, "a", "\n".join(scattered)), *((10 + k, f"b{k}", "\n".join([line() for _ in range(20)] + b)) for k, b in enumerate(blocks)), (30, "c", "\n".join(scattered[:24] + [line()] + scattered[24:60] + [line() for _ in range(3)]))]
    hot = "\n".join(line() for _ in range(10))
    rows += [(100 + k, f"h{k}", hot) for k in range(30)] + [(200 + k, "one", hot) for k in range(5)] + [(300, "h3", hot)]
    df = spark.createDataFrame([(a, b, "x", c) for a, b, c in rows + rows[:3] + rows[-3:]], "file_id long, repo string, path string, content string").repartition(3)
    for rare in (2, 16, 100):
        counts = {r["file_id"]: (r["lines"], r["holds"]) for r in containment(df, "file_id", "repo", "path", "content", rare).collect()}
        hashes = {a: (b, line_hashes(c)) for a, b, c in rows}
        repositories = {}
        for b, h in hashes.values():
            for x in h:
                repositories.setdefault(x, set()).add(b)
        for key, (b, h) in hashes.items():
            common = sum(len(repositories[x]) > rare for x in h)
            best = max((sum(o in repositories[x] for x in h if len(repositories[x]) <= rare) for o in {x[0] for x in hashes.values()} - {b}), default=0)
            assert counts[key] == (len(h), best + common), (rare, key)
