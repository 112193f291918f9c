"""Loops over packed edges against those over tables."""

from __future__ import annotations

import random

from siftwright.operators import dense, graph


def links(spark, seed, n, m):
    rng = random.Random(seed)
    rows = [(rng.randrange(n) * 10**12 - 5, rng.randrange(n) * 10**12 - 5, rng.choice([0.1, 0.2, 1.0, 2.0, 0.0])) for _ in range(m)]
    return spark.createDataFrame([*rows, *rows[:9], (None, 5, 1.0)], "src long, dst long, weight double").repartition(3)


def test_label_propagation_is_that_of_tables(spark, monkeypatch):
    edges = links(spark, 4, 80, 150)
    got = {r.id: r.label for r in graph.label_propagation(edges).collect()}
    calls = []
    monkeypatch.setattr(dense, "fits", lambda *_: calls.append(1))
    assert got == {r.id: r.label for r in graph.label_propagation(edges).collect() if r.id is not None}
    assert calls and 1 < len(set(got.values())) < len(got)


def test_pagerank_is_that_of_tables(spark, monkeypatch):
    edges = links(spark, 5, 60, 200)
    nodes = spark.createDataFrame([(i * 10**12 - 5,) for i in range(50)] + [(7,)], "id long")
    ranks = lambda t: {r.id: r["rank"] for r in graph.pagerank(nodes, edges, tolerance=t).collect()}
    got = [ranks(None), ranks(1e-3)]
    monkeypatch.setattr(dense, "NODES", 1)
    want = ranks(None)
    assert got[0].keys() == want.keys() and len(want) == 51
    assert all(abs(got[0][k] - want[k]) < 1e-9 for k in want) and all(abs(got[1][k] - want[k]) < 0.1 for k in want)


def test_packs_hold_all_edges_of_a_head(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(dense, "PACK", 10)
    s = np.sort(np.array([1] * 25 + [2] * 3 + list(range(3, 40)), np.int32))
    batches = [pa.record_batch([pa.array(s[i : i + 4]), pa.array(s[i : i + 4]), pa.array(s[i : i + 4] * 1.0)], ["s", "d", "w"]) for i in range(0, len(s), 4)]
    got = [np.frombuffer(b.column(0)[0].as_py(), np.int32) for b in dense._pack(iter(batches))]
    assert np.array_equal(np.concatenate(got), s) and len(got) > 3
    assert not any({*a.tolist()} & {*b.tolist()} for a, b in zip(got, got[1:]))


def test_components_and_cycles_are_those_of_tables(spark, monkeypatch):
    """On the driver alone, over packs, and over tables: random graphs, a ring against the order of its ids, chained rings."""
    rng = random.Random(6)
    edges = links(spark, 6, 120, 170).select("src", "dst")
    ring = [(10**15 + i, 10**15 + i - 1) for i in range(1, 12)] + [(10**15, 10**15 + 11), (10**15 + 3, 10**15 + 9), (10**15 + 8, 10**15 + 2)]
    chain = [x for i in range(4) for a in (-(10**13) + 10 * i,) for x in ((a, a + 1), (a + 1, a + 2), (a + 2, a), (a + 1, a), (a + 2, a + 11))]
    rng.shuffle(ring)
    edges = edges.union(spark.createDataFrame([*ring, *chain], "src long, dst long")).repartition(3)

    def run():
        parts = graph.scc(edges)
        found = [(r.id, r.component) for r in parts.collect()]
        rings = [(r.component, r.cycle) for r in graph.cycles(edges, parts).collect()]
        assert len(found) == len(set(found)) and len(rings) == len(dict(rings))
        return dict(found), dict(rings)

    alone = run()
    monkeypatch.setattr(dense, "PACK", 7)
    monkeypatch.setattr(dense, "ALONE", 30)
    packed = run()
    monkeypatch.setattr(dense, "ALONE", 0)
    assert run() == packed
    monkeypatch.setattr(dense, "fits", lambda *_: False)
    assert alone == packed == run()
    assert len(alone[1]) > 6 and max(map(len, alone[1].values())) > 4


def test_long_rings_take_no_more_tables_than_short_ones(spark):
    """Both loops used to write tables for every few hops, as many as the ring was long."""

    def made(n):
        edges = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long")
        before = len(graph._made)
        (row,) = graph.cycles(edges, graph.scc(edges)).collect()
        assert row.component == 0 and row.cycle == list(range(n))
        return len(graph._made) - before

    assert made(24) == made(3) < 6
