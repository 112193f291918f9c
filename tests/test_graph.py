from __future__ import annotations

from siftwright.operators import graph


def ranks(spark, ids, edges):
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    return {r.id: r["rank"] for r in graph.pagerank(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}


def test_pagerank_star_and_unknown_ends(spark):
    got = ranks(spark, range(1, 6), [(2, 1), (3, 1), (4, 1), (5, 1)])
    assert got[1] == 1.0 and all(got[i] < 1 for i in range(2, 6))
    got = ranks(spark, [1, 2], [(99, 1), (2, 1)])
    assert len(got) == 2 and got[1] > got[2]


def test_pagerank_without_edges_or_nodes(spark):
    assert set(ranks(spark, [1, 2, 3], []).values()) == {1.0}
    assert ranks(spark, [], []) == {}


def test_two_triangles_are_two_clusters(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 5, 1.0), (5, 6, 1.0), (6, 4, 1.0)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i, float(i)) for i in range(1, 8)], "id long, rank double")
    got = {r.id: (r.cluster, r.size, r.hub) for r in graph.clusters(nodes, edges).collect()}
    assert len(got) == 6 and len({c for c, _, _ in got.values()}) == 2
    assert got[4] == (1, 3, 6) and got[1] == (2, 3, 3)


def propagate(spark, pairs):
    return {r.id: r.label for r in graph.label_propagation(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")).collect()}


def settled(pairs, labels):
    """Whether updates in place, one node after the other, leave all labels as they are."""
    near: dict = {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, []).append(y)
    for i, others in near.items():
        votes: dict = {}
        for j in others:
            votes[labels[j]] = votes.get(labels[j], 0) + 1
        if votes.get(labels[i], 0) < max(votes.values()):
            return False
    return set(near) == set(labels)


def test_label_propagation_settles(spark):
    """Graphs whose nodes would swap labels for ever if all moved at once: an edge, a star, both sides of K(3,3)."""
    for pairs in ([(1, 2)], [(0, i) for i in range(1, 8)], [(a, b) for a in (1, 2, 3) for b in (4, 5, 6)]):
        got = propagate(spark, pairs)
        assert len(set(got.values())) == 1 and settled(pairs, got)


def test_label_propagation_is_what_updates_in_place_leave(spark):
    import random

    rng = random.Random(3)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60)) if a < b})
    assert settled(pairs, propagate(spark, pairs))


def test_scc(spark):
    run = lambda e: {(r.id, r.component) for r in graph.scc(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert run([(1, 2), (2, 3)]) == set()
    assert run([(1, 2), (2, 1), (5, 5)]) == {(1, 1), (2, 1)}
    assert run([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4)]) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_scc_of_ids_over_all_of_long(spark):
    top, low = (1 << 63) - 1, -(1 << 63)
    run = lambda e: {(r.id, r.component) for r in graph.scc(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert run([((1 << 62) + 5, (1 << 62) + 9), ((1 << 62) + 9, (1 << 62) + 5)]) == {((1 << 62) + 5, (1 << 62) + 5), ((1 << 62) + 9, (1 << 62) + 5)}
    assert run([(top, low), (low, top), (top - 1, top), (0, top - 1)]) == {(low, low), (top, low)}


def test_cycles_are_shortest_and_start_at_the_least(spark):
    e = spark.createDataFrame([(3, 1), (1, 2), (2, 3), (2, 9), (9, 3), (4, 5), (5, 4), (5, 6)], "src long, dst long")
    got = {r.component: r.cycle for r in graph.cycles(e, graph.scc(e)).collect()}
    assert got == {1: [1, 2, 3], 4: [4, 5]}
    assert graph.cycles(e.limit(0), graph.scc(e.limit(0))).count() == 0


def test_new_cycles_and_spikes(spark):
    comp = lambda rows: spark.createDataFrame(rows, "id long, component long")
    got = graph.new_cycles(comp([(1, 1), (2, 1)]), comp([(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)])).collect()
    assert [(r.component, r["size"]) for r in got] == [(7, 2)]
    e = lambda n: spark.createDataFrame([(i, 0) for i in range(1, n + 1)], "src long, dst long")
    assert [(r.id, r.fan_in_before, r.fan_in_after) for r in graph.fan_in_spikes(e(49), e(50)).collect()] == [(0, 49, 50)]
    assert not graph.fan_in_spikes(e(50), e(60)).collect()


def test_layers_leave_cycles_without_a_level(spark):
    got = {r.id: r.level for r in graph.layers(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (8, 9), (9, 8)], "src long, dst long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 8: -1, 9: -1}


def test_edits_replace_out_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    got = graph.apply_edits(e, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, 3)], "src long, dst long")).collect()
    assert {tuple(r) for r in got} == {(1, 3), (2, 3)}


def test_lpa_clusters_takes_all_parts_and_pairs(spark, tmp_path):
    from siftwright.plans.catalog import QUERIES

    # two groups of parts beyond 400, each bought together; (a * 7 + b * 3) % 5 takes every value among the pairs
    groups = [range(901, 906), range(2001, 2004)]
    items = [(order, part) for order, g in enumerate(groups) for part in g]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(part, float(part)) for _, part in items] + [(7, 1.0)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.id: (r.cluster, r.size, r.total, r.hub) for r in QUERIES["lpa_clusters"](spark, str(tmp_path)).collect()}
    want = sorted(((sum(map(float, g)), g) for g in groups), reverse=True)
    assert got == {i: (k, len(g), total, max(g)) for k, (total, g) in enumerate(want, 1) for i in g}
