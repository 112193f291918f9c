from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftwright.sources import files, parsers


def test_tree_scan_and_freshness(spark, tmp_path):
    for name, text in {"a.py": "def f():\n    return 1\n", "sub/b.ts": "export class B {\n}\n", "node_modules/x.js": "x", "keep.log.py": "y = 1", "skip.log.py": "z", "note.txt": "no"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    got = files.scan(spark, str(tmp_path), ["*.log.py", "!keep.log.py"])
    assert {(r.path, r.language) for r in got.collect()} == {("a.py", "python"), ("sub/b.ts", "typescript"), ("keep.log.py", "python")}
    old = spark.createDataFrame([("a.py", 1), ("gone.py", 1), ("c.py", 2)], "path string, mtime int")
    new = spark.createDataFrame([("a.py", 2), ("c.py", 2), ("d.py", 1)], "path string, mtime int")
    assert files.freshness(old, new).first()[:] == (1, 1, 1, 1)
    chunks = parsers.chunks(got)
    assert {(r.name, r.type) for r in chunks.collect()} >= {("f", "function"), ("B", "class")}
    assert parsers.describe(chunks).where("name = 'f'").first().description == "function 'f' in a.py"


def test_weights_take_the_last_glob(spark):
    df = spark.createDataFrame([("src/a.py",), ("docs/b.md",)], "p string")
    got = [r[0] for r in df.select(files.weights(F.col("p"), [("src/", 3), ("**/*.py", 20)])).collect()]
    assert got == [10.0, 1.0]


def names(text, lang):
    return [(t, n) for t, n, *_ in parsers.parse_code(text, lang)[0]]


def test_languages():
    assert names("func (s *S) Run() {\n}\ntype T struct {\n}\n", "go") == [("function", "Run"), ("class", "T")]
    assert names("pub fn f() {\n}\nstruct S {\n}\ntrait Q {\n}\n", "rust") == [("function", "f"), ("class", "S"), ("interface", "Q")]
    assert names("public class A {\n  public int f(int x) {\n  }\n}\n", "java") == [("class", "A"), ("method", "f")]
    assert names("class A\n  def f\n    1\n  end\nend\n", "ruby") == [("class", "A"), ("method", "f")]
    assert names("(defn f [x]\n  (+ x 1))\n", "clojure") == [("function", "f")]
    assert names("def f(x):\n    return (\n        x\n    )\n\ny = 1\n", "python") == [("function", "f")]
    assert names("static int f(int x)\n{\n  return 1;\n}\n", "c") == [("function", "f")]
    assert names("local function f(x)\n  return 1\nend\n", "lua") == [("function", "f")]
    assert names("defmodule A do\n  def f(x) do\n    x\n  end\nend\n", "elixir") == [("module", "A"), ("function", "f")]
    assert names("fun f(x: Int): Int {\n}\n", "kotlin") == [("function", "f")]


def test_fallback_windows_and_header():
    got = parsers.parse_code("\n".join(f"x{i}" for i in range(120)), "python")[0]
    assert [(a, b) for _, _, a, b, _ in got] == [(1, 50), (51, 100), (101, 120)]
    head = "// this file says at some length what it is for\n// and goes on for a second line\nfunction f() {\n}\n"
    assert names(head, "javascript") == [("module", "_module"), ("function", "f")]
    assert parsers.parse_code("", "python") == ([], [])


def test_notebook_and_vue():
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n", "hi"]}, {"cell_type": "code", "source": "x = 1"}, 7]})
    assert [t for t, *_ in parsers.parse_notebook(nb)] == ["doc_section", "block"]
    assert parsers.parse_notebook("{broken") == []
    chunks, imports = parsers.parse_vue("<template>\n<MyPart/>\n</template>\n<script>\nimport a from './a'\nfunction f() {\n}\n</script>\n")
    assert ("function", "f") in [(t, n) for t, n, *_ in chunks]
    assert {s for s, _, _ in imports} == {"MyPart", "./a"}


def test_vue_scripts_components_and_reactive_values():
    text = """<template>
  <!-- <Ghost/> -->
  <user-card :title="'<Quoted/>'"/> {{ '<Inner/>' }}
  <BaseButton>go</BaseButton>
  <p>plain</p>
</template>

<script>
export default { name: 'x' }
function legacy() {
}
</script>

<script setup lang="ts">
import { ref, computed } from 'vue'
const count = ref(0)
const twice = computed(() => count.value * 2)
function bump() {
}
</script>

<i18n>
{}
</i18n>
"""
    chunks, imports = parsers.parse_vue(text)
    found = {(t, n): a for t, n, a, *_ in chunks}
    assert found["variable", "count"] == 16 and ("variable", "twice") in found and {("function", "bump"), ("function", "legacy")} <= set(found)
    assert [n for t, n, *_ in chunks if t == "block"] == ["template", "script", "script", "i18n"]
    assert {s for s, _, _ in imports} == {"UserCard", "BaseButton", "vue"}


def test_graphql_selection_trees():
    text = """const q = gql`query Q($id: ID!) { me: user(id: $id) { name ...Card ... on Admin { role } posts(first: 2) { title } } # no
 other @include(if: $x) }
fragment Card on User { avatar }
mutation { save { ok } }`; graphql(`{ plain }`)"""
    assert [p for p, _ in parsers.graphql_selections(text)] == ["Query.user", "Query.user.name", "Query.user.role", "Query.user.posts", "Query.user.posts.title", "Query.other", "Mutation.save", "Mutation.save.ok", "Query.plain"]
    assert [p for p, _ in parsers.graphql_uses(text)] == ["Query.user", "Query.other", "Mutation.save", "Query.plain"]
