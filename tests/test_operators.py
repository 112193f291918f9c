from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from siftwright.functions.vectors import cosine, max_sim
from siftwright.operators import code, memory, ranking, relational, search, stats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_max_sim_and_cosine_of_nothing(spark):
    df = spark.createDataFrame([([], [], [0.0, 0.0], [1.0, 0.0])], "q array<array<double>>, d array<array<double>>, a array<double>, b array<double>")
    assert df.select(max_sim(F.col("q"), F.col("d")), cosine(F.col("a"), F.col("b"))).first()[:] == (0.0, 0.0)


def test_imports(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("lib/pkg/mod.py",)], "path string")
    imports = spark.createDataFrame([("src/x.ts", "./a"), ("src/b/y.ts", "../a.js"), ("src/x.ts", "./b"), ("src/x.ts", "./none")], "source string, spec string")
    assert rows(relational.resolve_imports(imports, files)) == [("src/b/y.ts", "../a.js", "src/a.ts"), ("src/x.ts", "./a", "src/a.ts"), ("src/x.ts", "./b", "src/b/index.ts")]
    python = spark.createDataFrame([("p/a.py",), ("p/q/b.py",), ("p/q/__init__.py",)], "path string")
    specs = spark.createDataFrame([("p/x.py", ".a"), ("p/q/y.py", "..a"), ("p/x.py", ".q.b"), ("p/x.py", ".q"), ("p/q/y.py", "."), ("p/x.py", ".none")], "source string, spec string")
    assert rows(relational.resolve_imports(specs, python)) == [("p/q/y.py", ".", "p/q/__init__.py"), ("p/q/y.py", "..a", "p/a.py"), ("p/x.py", ".a", "p/a.py"), ("p/x.py", ".q", "p/q/__init__.py"), ("p/x.py", ".q.b", "p/q/b.py")]
    dotted = spark.createDataFrame([("m.py", "pkg.mod"), ("m.py", "pkg.*")], "source string, spec string")
    assert rows(relational.resolve_packages(dotted, files)) == [("m.py", "pkg.mod", "lib/pkg/mod.py")]


def test_tests_by_name(spark):
    files = spark.createDataFrame([("src/a.py",), ("tests/test_a.py",), ("src/b.ts",), ("src/b.test.ts",), ("src/c.go",)], "path string")
    assert rows(relational.related_tests(files)) == [("src/a.py", "tests/test_a.py"), ("src/b.ts", "src/b.test.ts")]


def test_memory_conflicts_need_a_shared_pin_and_another_commit(spark):
    m = spark.createDataFrame([(1, ["p", "q"], "s1", 1), (2, ["p", "q"], "s2", 2), (3, ["p"], "s1", 3), (4, [], "s9", 4), (5, ["z"], None, 5), (6, ["z"], None, 6)], "id long, pins array<string>, sha string, at long")
    assert rows(relational.shared_pins(m, "id", F.col("pins"), "sha", "at")) == [(1, 2, 2), (2, 3, 1), (5, 6, 1)]


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40)], "g int, id long, cost long")
    assert rows(ranking.pack_skip(df, ["g"], [F.col("id")], "cost", "id", 100)) == [(1, 1, 60, 0), (1, 3, 40, 0)]
    assert [r.id for r in ranking.pack_stop(df, ["g"], [F.col("id")], "cost", 100).collect()] == [1]


def test_span_verification(spark):
    files = spark.createDataFrame([("f", "a\nb\nc\nd\nthe quick brown fox jumps\nf")], "path string, text string")
    e = spark.createDataFrame([(1, "f", 2, 3, "b\nc"), (2, "f", 1, 2, "b\nc"), (3, "f", 5, 5, "the quick brown fox jumped over"), (4, "f", 5, 5, "nothing like it at all"), (5, "gone", 1, 1, "a"), (6, "f", 5, 5, "the quick brown fox")], "id long, path string, start int, end int, span string")
    got = {r.id: (r.status, r.found_start) for r in memory.verify_spans(e, files).collect()}
    assert got == {1: ("unchanged", 2), 2: ("moved", 2), 3: ("deleted", None), 4: ("deleted", None), 5: ("deleted", None), 6: ("modified", 5)}


def test_consolidation(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (7, 8)], "a long, b long")
    assert rows(memory.consolidate(None, pairs, "id")) == [(1, 3)]


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "Use `Alpha` here.\n\nBoth Beta and Gamma matter.\n\nOnly Delta.\n\n```\nEpsilon()\n```")], "id long, text string")
    known = spark.createDataFrame([(x,) for x in ("Alpha", "Beta", "Gamma", "Delta", "Epsilon")], "symbol string")
    assert rows(code.doc_mentions(docs, "id", F.col("text"), known)) == [(1, "Alpha", 1.0), (1, "Beta", 0.5), (1, "Epsilon", 0.8), (1, "Gamma", 0.5)]
    defs = spark.createDataFrame([("Alpha", 1, "function", 0.9), ("Alpha", 2, "class", 0.1)], "symbol string, target long, kind string, rank double")
    assert rows(code.link_symbols(code.doc_mentions(docs, "id", F.col("text"), known), defs)) == [(1, "Alpha", 2)]


def test_calls_skip_strings_comments_and_keywords(spark):
    docs = spark.createDataFrame([(1, 'foo(bar(1)); foo(2)\nif (x) { "nope()" } // late()\nnew_one()')], "id long, text string")
    assert rows(code.call_references(docs, "id", F.col("text"))) == [(1, 1, "bar"), (1, 1, "foo"), (1, 3, "new_one")]


def test_diffs(spark):
    names = spark.createDataFrame([("A\tx",), ("M\ty",), ("D\tz",), ("R100\told\tnew",), ("C75\tp\tq",)], "l string")
    assert sorted((r.path, r.status, r.old_path) for r in code.change_status(names, "l").collect()) == [("new", "renamed", "old"), ("q", "added", None), ("x", "added", None), ("y", "modified", None), ("z", "deleted", None)]
    text = ["--- a/f.py", "+++ b/f.py", "@@ -3,2 +3,3 @@ def f():", " a", "-b", "+c"]
    got = code.diff_lines(spark.createDataFrame(list(enumerate(text)), "line int, t string"), "t").collect()
    assert [tuple(r) for r in got] == [("f.py", 3, 3, " ", "a"), ("f.py", 3, 3, "-", "b"), ("f.py", 3, 3, "+", "c")]


def test_grep_blocks_take_unsafe_patterns_literally(spark):
    t = spark.createDataFrame([("intro\n## one\nx\n## two\n(a+)+ y",)], "t string")
    assert [r.block for r in code.grep_blocks(t, "t", "(a+)+").collect()] == ["## two\n(a+)+ y"]
    assert code.grep_blocks(t, "t", "^## one").count() == 1


def test_log_memories(spark):
    log = spark.createDataFrame([("feat(api): add a new way to list things",), ("chore: tidy up the build scripts",), ("wip",), ("fix: short",)], "s string")
    assert sorted((r.type, r.category) for r in code.git_log_memories(log, "s").collect()) == [("chore", "context"), ("feat", "decision")]


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "id long, text string")
    assert search.bm25(docs, "id", F.col("text"), ["x"]).count() == 0
    assert search.bm25(docs, "id", F.col("text"), []).count() == 0
    assert code.chunk_windows(docs, "id", F.col("text")).count() == 0


def test_profile_and_opportunity(spark):
    calls = spark.createDataFrame([("a",)] * 19 + [("b",)], "tool string")
    profiles = spark.createDataFrame([("small", "a"), ("big", "a"), ("big", "b")], "profile string, tool string")
    assert rows(stats.profile_coverage(calls, "tool", profiles)) == [("big", 2, 20, 1.0, False), ("small", 1, 19, 0.95, True)]
    df = spark.createDataFrame([("spark and delta and arrow", 5.0), ("none", 500.0)], "t string, h double")
    assert [r[0] for r in df.select(stats.opportunity(F.col("t"), F.col("h"), ("spark", "delta", "arrow"))).collect()] == [100, 17]


def test_daily_fills_gaps(spark):
    at = datetime.datetime
    df = spark.createDataFrame([(at(2024, 1, 1, 5), 1, "ok"), (at(2024, 1, 3, 5), 1, "error")], "ts timestamp_ntz, u long, t string")
    got = [(str(r.day), r.events, r.error_rate) for r in stats.daily(df, "ts", "u", F.col("t") == "error").orderBy("day").collect()]
    assert got == [("2024-01-01", 1, 0.0), ("2024-01-02", 0, 0.0), ("2024-01-03", 1, 1.0)]


def test_paths_and_boosts(spark):
    from siftwright.operators import audit

    df = spark.createDataFrame([("src/main.py", "src/a/b.py"), ("node_modules/x/y.js", "z.py"), ("tests/test_a.py", "t.py"), ("src/index.ts", "src/q.ts")], "p string, c string")
    got = [tuple(r) for r in df.select(audit.path_classes(F.col("p")), audit.production(F.col("p")), F.round(audit.boost(F.col("p"), F.lit(1.0), F.col("c"), F.lit(9)), 4)).collect()]
    assert got == [("cli", True, round(1.05 * 1.4 * 0.975 * 1.3, 4)), ("vendored", False, round(1.4 * 0.925 * 1.3, 4)), ("test", False, round(1.4 * 0.95 * 1.3, 4)), ("barrel", True, round(1.05 * 1.4 * 1.3, 4))]


def test_review_rules(spark):
    from siftwright.operators import audit

    added = [" ", "+", "+", " "]
    lines = ["stream.pipe(", "  parse(chunk)", "  done", ")"]
    diff = spark.createDataFrame([("f.js", 10, o, t, i) for i, (o, t) in enumerate(zip(added, lines, strict=True))], "file string, new_start int, op string, content string, line int")
    assert [(r.line, r.content) for r in audit.unguarded_stream_calls(diff).collect()] == [(11, "parse(chunk)")]
    guarded = diff.withColumn("content", F.when(F.col("line") == 0, "try { stream.pipe(").otherwise(F.col("content")))
    assert audit.unguarded_stream_calls(guarded).count() == 0
    num = spark.createDataFrame([("3\t1\ta.py",), ("-\t-\tb.png",)], "l string")
    names = spark.createDataFrame([("b.png", "added")], "path string, status string")
    assert rows(audit.change_sizes(num, names, "l")) == [("a.py", 3, 1, "modified"), ("b.png", 0, 0, "added")]


def test_answers_are_criticised(spark):
    from siftwright.operators import audit

    sym = lambda *x: spark.createDataFrame([(s,) for s in x], "symbol string")
    paths = lambda *x: spark.createDataFrame([(s,) for s in x], "path string")
    spans = lambda *x: spark.createDataFrame(list(enumerate(x)), "id int, status string")
    run = lambda *a: audit.critique(*a).first()
    assert run(sym("A"), sym("A"), paths("x"), paths("x"), spans("unchanged")).verdict == "PASS"
    assert run(sym("A", "Q"), sym("A"), paths("x"), paths("x"), spans("unchanged"))[:] == (0, 1, False, "WARN")
    assert run(sym("A", "B", "C"), sym("A", "B", "C"), paths("y"), paths("x"), spans("unchanged")).missed_hubs
    assert run(sym("A"), sym("A"), paths("x"), paths("x"), spans("deleted", "unchanged")).verdict == "FAIL"


def test_rule_engines(spark):
    from siftwright.operators import audit

    items = spark.createDataFrame([(1, "opportunity", "new"), (2, "brief", "queued")], "id int, type string, status string")
    done, bad = audit.decide(items, spark.createDataFrame([(1, "approve"), (2, "approve")], "id int, decision string"))
    assert rows(done) == [(1, "opportunity", "briefed"), (2, "brief", "queued")] and rows(bad) == [(2, "approve")]
    drafts = spark.createDataFrame([("one two three four five six seven eight nine",), ("the best thing",)], "t string")
    seen = spark.createDataFrame([("One two three four five six seven eight ten",)], "t string")
    assert [r.failed for r in audit.content_gates(drafts, "t", seen).orderBy("t").collect()] == ["repeated_angle", "unsupported_claim"]
    s = audit.scout(spark.createDataFrame([(1, 50), (2, 90)], "id int, s int"), F.col("s"), {"old": F.col("s") < 60, "off": F.lit(False)})
    assert [(r.id, r.status, r.place) for r in s.orderBy("place").collect()] == [(2, "briefed", 1), (1, "needs_review", 2)]


def test_recall_appends_pins(spark):
    from siftwright.operators import audit

    lanes = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.9)], "id long, score double")
    mem = spark.createDataFrame([(1, 1.0, None, 0), (2, 1.0, None, 100), (3, 1.0, "x", 0)], "id long, confidence double, invalidated_at string, age int")
    got = [tuple(r) for r in audit.recall(lanes, mem, F.col("age"), 5, spark.createDataFrame([(1,), (9,)], "id long")).collect()]
    assert got == [(1, 0.5, False), (2, 0.2, False), (9, 1.0, True)]


def test_markdown_memories_and_vectors(spark):
    import numpy as np

    from siftwright.operators import audit

    md = "intro\n## Choices\n- we keep every row of the table\n- short\n- never drop a row to escape skew\n## Note\nThe first paragraph counts here.\n\nNot this."
    got = rows(audit.markdown_memories(spark.createDataFrame([(md,)], "t string"), "t"))
    assert got == [("Choices", "never drop a row to escape skew"), ("Choices", "we keep every row of the table"), ("Note", "The first paragraph counts here.")]
    v = audit.embed(spark.createDataFrame([(1, "some words"), (2, None)], "id long, t string"), "id", "t").orderBy("id").collect()
    assert abs(np.linalg.norm(v[0].vector) - 1) < 1e-5 and not any(v[1].vector)


def test_top_decile_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(float(i % 40),) for i in range(1000)], "s double")
    values = sorted((float(i % 40) for i in range(1000) if i % 40), reverse=True)
    assert ranking.top_decile(df, "s").first()[:] == (values[len(values) // 10 - 1], len(values))
    assert ranking.top_decile(df.limit(0), "s").first()[:] == (None, None)
    assert ranking.top_decile(spark.createDataFrame([(3.0,)], "s double"), "s").first()[:] == (3.0, 1)


def test_fallback_vectors_take_every_word_character_and_document(spark, sf_dir):
    import math

    from siftwright.operators import audit
    from siftwright.plans.catalog import QUERIES

    def plain(text, dims=384):
        v = [0.0] * dims
        for w, word in enumerate(text.lower().split(" ")):
            for c in word:
                for d in range(dims):
                    v[d] += math.sin(ord(c) * (d + 1) * 0.01 + w * 0.1) / (1 + w * 0.1)
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v]

    long_ = " ".join(f"Word{i}" for i in range(140))
    for text in ("ab ba", "ba ab", " lead", long_, long_ + " more"):
        assert max(abs(x - y) for x, y in zip(audit.fallback_vector(text), plain(text), strict=True)) < 1e-6
    assert not audit.fallback_vector("").any()
    assert abs(audit.fallback_vector(long_) - audit.fallback_vector(long_ + " more")).max() > 1e-6
    assert QUERIES["fallback_vectors"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
