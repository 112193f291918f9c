"""Joins that would hold a row for each pair of a group, in forms that grow with their input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from siftwright.operators import audit, graph, search


def plan(df):
    return df._jdf.queryExecution().toString()


def test_neighbours_match_all_pairs(spark):
    rng = random.Random(5)
    chunks = [(i, rng.randrange(3), rng.randrange(20)) for i in rng.sample(range(500), 150)] + [(600, 9, 1), (601, None, 1), (602, 1, None)]
    df = spark.createDataFrame(chunks, "id long, file long, start long").withColumn("end", F.col("start") + 3)
    hits = spark.createDataFrame([(i,) for i, _, _ in chunks[::3]] + [(600,), (9999,)], "id long")
    out = audit.neighbours(hits, df, 3)
    got = {}
    for r in out.collect():
        got.setdefault(r.hit, []).append((r.distance, r.near))
    want = {}
    for i, f, s in chunks:
        if i == 600 or (i, f, s) in chunks[::3]:
            near = sorted((float(abs(s - o)), j) for j, g, o in chunks if j != i and g == f and f is not None and o is not None and s is not None)[:3]
            want |= {i: near} if near else {}
    assert {h: sorted(v) for h, v in got.items()} == want
    # no join on the file alone
    assert "place" in plan(out)


def test_hops_within_groups(spark):
    rng = random.Random(6)
    members = [(rng.randrange(40), rng.randrange(60)) for _ in range(90)]
    df = spark.createDataFrame(members, "`group` long, id long")
    a, b = (df.select("group", F.col("id").alias(c)) for c in ("src", "dst"))
    seeds = spark.createDataFrame([(members[0][1],), (members[0][1],), (777,)], "id long")
    got = sorted(map(tuple, graph.bfs_groups(seeds, df, 3).collect()))
    assert got == sorted(map(tuple, graph.bfs(seeds, a.join(b, "group").where("src <> dst"), 3).collect())) and len(got) > 10


def test_words_that_nobody_asks_are_not_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the cat sat " + " ".join(f"w{i}x{j}" for j in range(50))) for i in range(20)] + [(99, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "the w3x1 w3x1"), (2, "nothing")], "q int, body string")
    tables, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: tables.append(df) or cut(df))
    got = {(r.q, r.id): r.score for r in search.bm25_batch(docs, asked, "id", F.col("text"), "q", F.col("body")).collect()}
    assert set(got) == {(1, i) for i in range(20)} and max(got, key=got.get) == (1, 3)
    # asked words are joined before any count by document
    kept = plan(tables[-1]).split("== Physical Plan ==")[1]
    assert kept.index("HashAggregate") < kept.index("BroadcastHashJoin")
    monkeypatch.setattr(search, "TERMS", 0)
    again = {(r.q, r.id): r.score for r in search.bm25_batch(docs, asked, "id", F.col("text"), "q", F.col("body")).collect()}
    assert again.keys() == got.keys() and all(abs(again[k] - got[k]) < 1e-9 for k in got)
