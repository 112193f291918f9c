"""Query sets against vectors by matrix products."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftwright.operators import memory, vector


def dot(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += (x or 0.0) * (y or 0.0)
    return s


def odd_vectors(rng, n):
    rows = [(i, [rng.choice([-1.0, 0.5, 0.1, 0.3, 1e-9]) for _ in range(3)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.5]), (n + 3, [None, 1.0, 0.3]), (n + 4, [1e30, 1e-30, 1.0]), (n + 5, [-1e300, 1.0, 1.0])]
    return rows + [(n + 10 + i, v) for i, v in rows[:20]]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_top_k_of_a_query_set(spark):
    rows = odd_vectors(random.Random(1), 60)
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    q = df.where("id % 2 = 0").select(F.col("id").alias("q"), F.col("v").alias("w"))
    out = vector.top_k_blocks(df, q, "id", "v", "q", "w", 5, -0.2)
    got = {(r.q, r.rank): (r.id, r.score) for r in out.collect()}
    want = {}
    for i, w in rows:
        if i % 2 == 0 and w is not None:
            s = sorted((-dot(w, v), j) for j, v in rows if v is not None and dot(w, v) >= -0.2)
            want |= {(i, r): (j, -x) for r, (x, j) in enumerate(s[:5], 1)}
    assert got == want
    # no row for each pair of a query and a vector
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_top_k_over_many_batches():
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(20_000, 4)), 1)
    v[500:900] = v[7]

    class Shared:
        value = v[::400]

    batches = [pa.record_batch([pa.array(range(at, at + 5000)), pa.array(list(v[at : at + 5000]))], ["id", "v"]) for at in (10_000, 0, 15_000, 5000)]
    (out,) = vector._nearest(Shared, 7, -2.0)(iter(batches))
    got = list(zip(*(c.to_pylist() for c in out.columns)))
    want = []
    for i, q in enumerate(Shared.value.tolist()):
        want += [(i, j, -s) for s, j in sorted((-dot(q, w), j) for j, w in enumerate(v.tolist()) if dot(q, w) >= -2)[:7]]
    assert got == want


def test_max_sim_of_a_table(spark):
    rows = [(i, v, f"d{i % 7}" if i % 7 else None) for i, v in odd_vectors(random.Random(2), 60) if i not in (64, 65)]
    df = spark.createDataFrame(rows, "id long, v array<double>, doc string").repartition(3)
    q = df.where("id % 3 = 0").select(F.col("id").alias("q"), F.col("v").alias("w"))
    out = vector.max_sim_table(df, q, "doc", "v", "q", "w")
    asked = [v for i, v, _ in rows if i % 3 == 0 and v is not None]
    for r in out.collect():
        want = sum(max(dot(w, v) for _, v, d in rows if d == r.doc and v is not None) for w in asked)
        assert math.isclose(r.max_sim, want, abs_tol=1e-9)
    assert out.count() == 7 and "NestedLoop" not in plan(out)


def test_nan_is_the_greatest(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [math.nan]), (3, [2.0])], "id long, v array<double>")
    q = df.where("id = 1").select(F.col("id").alias("q"), F.col("v").alias("w"))
    assert [r.id for r in vector.top_k_blocks(df, q, "id", "v", "q", "w", 2).orderBy("rank").collect()] == [2, 3]


def test_remember_takes_any_number_of_new_memories(spark):
    base = spark.range(0, 5000).select("id", F.lit("decision").alias("category"), F.lit("c").alias("content"), F.array(F.cos(F.col("id") * 1.0), F.sin(F.col("id") * 1.0)).alias("vector"), F.array(F.lit("f")).alias("related"))
    stamp = F.lit(None).cast("timestamp_ntz")
    old = base.where("id < 3").withColumns({"confidence": F.lit(1.0), "tier": F.lit("archive"), "kind": F.lit("semantic"), "valid_from": stamp, "invalidated_at": stamp, "superseded_by": F.lit(None).cast("long")})
    got = memory.remember(old, base.withColumn("id", F.col("id") + 10), "2024-06-01")
    assert got.count() == 5003
    want = {i: min(j + 10 for j in range(5000) if math.cos(i - j) >= 0.85) for i in range(3)}
    assert {r.id: r.superseded_by for r in got.where("id < 3").collect()} == want
