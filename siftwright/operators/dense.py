"""Graph loops over edges packed by their head: node values are one dense array, sent to every task in each step.

A step reads the packs and hands on what it found for the nodes; edges are shuffled once, before the first step.
"""

from __future__ import annotations

import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nodes whose values the driver and each task hold; beyond that, loops shuffle tables.
NODES = 20_000_000
#: Edges of a pack, but that all edges of a head are in one.
PACK = 1 << 18
#: Edges that the driver works through by itself, and those of a component that one task does.
ALONE = 1 << 20


def fits(*ids) -> bool:
    return all(isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) for t in ids)


def node_ids(nodes: DataFrame) -> np.ndarray | None:
    """The ids of nodes(id), distinct ones, in order; none if they are beyond NODES."""
    if nodes.count() > NODES:
        return None
    return np.sort(nodes.select(F.col("id").cast("long")).where("id IS NOT NULL").toArrow().column(0).to_numpy())


def _places(shared):
    """Edges (head, tail, weight) by the places of their ends; those with an unknown end are dropped."""

    def run(batches):
        ids = shared.value
        for b in batches:
            ends, known = [], np.ones(b.num_rows, bool)
            for i in (0, 1):
                x = b.column(i).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0))
                known &= (ids[at] == x) if len(ids) else False
                ends.append(at)
            yield pa.RecordBatch.from_arrays([*(pa.array(e[known].astype(np.int32)) for e in ends), pa.array(b.column(2).to_numpy(zero_copy_only=False)[known])], ["s", "d", "w"])

    return run


def places(edges: DataFrame, ids: np.ndarray) -> DataFrame:
    """(s, d, w): edges(s, d, w) with places in ``ids``, parallel ones merged, all of a head in one task and in order."""
    shared = edges.sparkSession.sparkContext.broadcast(ids)
    rows = edges.select(F.col("s").cast("long"), F.col("d").cast("long"), F.col("w").cast("double")).where("s IS NOT NULL AND d IS NOT NULL AND w IS NOT NULL")
    known = rows.mapInArrow(_places(shared), "s int, d int, w double")
    return known.repartition("s").groupBy("s", "d").agg(F.sum("w").alias("w")).sortWithinPartitions("s")


def _pack(batches):
    held: list = [np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)]
    parts: list = []

    def out(columns):
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["s", "d", "w"])

    for b in batches:
        parts.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if sum(len(p[0]) for p in parts) + len(held[0]) < PACK:
            continue
        held, parts = [np.concatenate(c) for c in zip(held, *parts)], []
        end = np.searchsorted(held[0], held[0][-1])
        if end:
            yield out([c[:end] for c in held])
            held = [c[end:] for c in held]
    held = [np.concatenate(c) for c in zip(held, *parts)]
    if len(held[0]):
        yield out(held)


def packs(links: DataFrame) -> DataFrame:
    """``places`` as rows of a few hundred thousand edges, which no reader parts."""
    from siftwright.operators.graph import cut

    return cut(links.mapInArrow(_pack, "s binary, d binary, w binary"))


def _step(shared, f):
    """(place, value) of what ``f`` finds for the heads of each pack."""

    def run(batches):
        for b in batches:
            for s, d, w in zip(*(c.to_pylist() for c in b.columns)):
                at, value = f(shared.value, np.frombuffer(s, np.int32), np.frombuffer(d, np.int32), np.frombuffer(w))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary())], ["place", "value"])

    return run


def step(packed: DataFrame | list, state, f, kind) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(packed, list):
        got = [f(state, *p) for p in packed]
        return np.concatenate([np.zeros(0, np.int32), *(at for at, _ in got)]), np.concatenate([np.zeros(0, kind), *(v for _, v in got)])
    shared = packed.sparkSession.sparkContext.broadcast(state)
    try:
        table = packed.mapInArrow(_step(shared, f), "place binary, value binary").toArrow()
    finally:
        shared.destroy()
    get = lambda i, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in table.column(i).to_pylist())])
    return get(0, np.int32), get(1, kind)


def _inflow(rank, s, d, w):
    heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    return s[heads], np.add.reduceat(rank[d] * w, heads)


def pagerank(ids: np.ndarray, links: DataFrame, iterations: int, damping: float, tolerance: float | None) -> np.ndarray:
    """Ranks of ``ids`` over ``places`` whose heads are targets."""
    from siftwright.operators.graph import cut

    links = cut(links)
    n = len(ids)
    out = np.zeros(n)
    deg = links.groupBy("d").agg(F.sum("w").alias("w")).toArrow()
    out[deg.column(0).to_numpy()] = deg.column(1).to_numpy()
    packed = packs(links.repartition("s").sortWithinPartitions("s"))
    rank = np.full(n, 1.0 / n)
    for _ in range(iterations):
        at, flow = step(packed, np.divide(rank, out, out=np.zeros(n), where=out > 0), _inflow, np.float64)
        new = np.full(n, (1 - damping) / n)
        new[at] += damping * flow
        moved, rank = np.abs(new - rank).max(), new
        if tolerance is not None and moved < tolerance:
            break
    return rank / rank.max()


def _vote(state, s, d, w):
    """Heads that take another label: all of them, those of the other half with their place negated less one."""
    ids, labels, turn, first = state
    heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    node = s[heads]
    near = labels[d].astype(np.int64)
    local = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(s))))
    order = np.argsort(local * len(ids) + near, kind="stable")
    local, near = local[order], near[order]
    start = np.flatnonzero(np.append(True, (local[1:] != local[:-1]) | (near[1:] != near[:-1])))
    votes = np.round(np.add.reduceat(w[order], start), 9)
    local, near = local[start], near[start]
    top = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
    most = np.maximum.reduceat(votes, top)
    old = labels[node].astype(np.int64)
    # the own label before others with as many votes, then the smallest
    choice = np.where(near == old[local], -1, near)
    choice[votes != most[local]] = len(ids)
    best = np.minimum.reduceat(choice, top)
    best = np.where(best == -1, old, best)
    moves = best != old
    node, best = node[moves], best[moves].astype(np.int32)
    early = np.fromiter((zlib.crc32(b"%d:%d" % (i, turn)) % 2 == 0 for i in ids[node].tolist()), bool, len(node))
    if first:
        return np.where(early, node, -1 - node), best
    return node[~early], best[~early]


def _labels(shared):
    def run(batches):
        ids, labels = shared.value
        for b in batches:
            for s in b.column(0).to_pylist():
                node = np.unique(np.frombuffer(s, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids[node]), pa.array(ids[labels[node]])], ["id", "label"])

    return run


def label_propagation(ids: np.ndarray, links: DataFrame, iterations: int) -> DataFrame:
    """(id, label) as ``graph.label_propagation`` says, over ``places`` in both directions."""
    from siftwright.operators.graph import cut

    packed = packs(links)
    labels = np.arange(len(ids), dtype=np.int32)
    for turn in range(iterations):
        at, best = step(packed, (ids, labels, turn, True), _vote, np.int32)
        now = at >= 0
        labels[at[now]] = best[now]
        rest, best = step(packed, (ids, labels, turn, False), _vote, np.int32)
        labels[rest] = best
        if not len(at):
            break
    shared = packed.sparkSession.sparkContext.broadcast((ids, labels))
    return cut(packed.select("s").mapInArrow(_labels(shared), "id long, label long"))


def _by(edges: DataFrame, head: str, tail: str, ids: np.ndarray) -> DataFrame:
    """``packs`` by the place of ``head``; heads beside each other are in one pack, so that a step gets far in graphs of near ids."""
    shared = edges.sparkSession.sparkContext.broadcast(ids)
    rows = edges.select(F.col(head).cast("long").alias("s"), F.col(tail).cast("long").alias("d"), F.lit(1.0).alias("w"))
    packed = packs(rows.repartitionByRange("s").sortWithinPartitions("s").mapInArrow(_places(shared), "s int, d int, w double"))
    shared.destroy()
    return packed


def _among(shared):
    """Packs without the edges of which an end is gone."""

    def run(batches):
        there = shared.value
        for b in batches:
            for s, d, w in zip(*(c.to_pylist() for c in b.columns)):
                s, d, w = np.frombuffer(s, np.int32), np.frombuffer(d, np.int32), np.frombuffer(w)
                keep = there[s] & there[d]
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array([x[keep].tobytes()], pa.binary()) for x in (s, d, w)], ["s", "d", "w"])

    return run


def _left(there, s, d, w):
    return np.zeros(1, np.int32), np.array([np.count_nonzero(there[s] & there[d])])


def _shrink(sides: list, there: np.ndarray) -> list:
    """Packings without the edges of which an end is gone; few edges come to the driver."""
    from siftwright.operators.graph import cut

    if isinstance(sides[0], list):
        return [[tuple(x[keep] for x in p) for p in side for keep in [there[p[0]] & there[p[1]]] if keep.any()] for side in sides]
    few = step(sides[0], there, _left, np.int64)[1].sum() <= ALONE
    shared = sides[0].sparkSession.sparkContext.broadcast(there)
    rest = [side.mapInArrow(_among(shared), "s binary, d binary, w binary") for side in sides]
    if not few:
        return [cut(side) for side in rest]
    return [_whole(*(np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in c.to_pylist())]) for c, t in zip(side.toArrow().columns, (np.int32, np.int32, np.float64)))) for side in rest]


def _whole(s, d, w) -> list:
    """One pack of all edges, or none."""
    order = np.argsort(s, kind="stable")
    return [(s[order], d[order], w[order])] if len(s) else []


def _within(s, d, keep):
    """(start of each head, its place, heads by tail, start of each tail): the edges of a pack, and of those to ``keep`` the ones whose tail is a head here."""
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    own = s[start]
    at = np.minimum(np.searchsorted(own, d), len(own) - 1)
    local = keep & (own[at] == d)
    head, tail = np.repeat(np.arange(len(own)), np.diff(np.append(start, len(s))))[local], at[local]
    order = np.argsort(tail, kind="stable")
    return start, own, head[order], np.searchsorted(tail[order], np.arange(len(own) + 1))


def _out(first, front):
    """(place in the front, edge) for all edges of its nodes, where ``first`` tells at which edge a node starts."""
    size = first[front + 1] - first[front]
    by = np.repeat(np.arange(len(front)), size)
    return by, np.arange(len(by)) + np.repeat(first[front] - (np.cumsum(size) - size), size)


def _held(there, s, d, w):
    """Heads that are there and have a tail that is; those without leave, and what hangs on them in the pack too."""
    start, own, head, first = _within(s, d, there[s] & there[d])
    left = np.add.reduceat(there[d].astype(np.int64), start)
    here = there[own]
    front = np.flatnonzero(here & (left == 0))
    while len(front):
        here[front] = False
        to = head[_out(first, front)[1]]
        np.subtract.at(left, to, 1)
        to = np.unique(to)
        front = to[here[to] & (left[to] == 0)]
    return own[here], np.zeros(np.count_nonzero(here), np.int8)


def _lower(state, s, d, w):
    """Heads whose label falls to that of a tail in their group, with the least that reaches them in the pack."""
    label, group = state
    same = group[s] == group[d]
    start, own, head, first = _within(s, d, same)
    old = label[own]
    here = np.minimum(old, np.minimum.reduceat(np.where(same, label[d], np.iinfo(np.int32).max), start))
    front = np.flatnonzero(here != old)
    while len(front):
        by, e = _out(first, front)
        to, via = head[e], here[front][by]
        falls = via < here[to]
        np.minimum.at(here, to[falls], via[falls])
        front = np.unique(to[falls])
    moved = here != old
    return own[moved], here[moved]


def _spread(packed, label: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Least label that reaches each node over edges within its group."""
    while True:
        at, value = step(packed, (label, group), _lower, np.int32)
        if not len(at):
            return label
        label[at] = value


def _members(shared):
    def run(batches):
        ids, component = shared.value
        for b in batches:
            for s in b.column(0).to_pylist():
                node = np.unique(np.frombuffer(s, np.int32))
                node = node[component[node] >= 0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[node]), pa.array(ids[component[node]])], ["id", "component"])

    return run


def scc(ids: np.ndarray, edges: DataFrame, least: int) -> DataFrame:
    """(id, component) as ``graph.scc`` says, over the edges(src, dst) whose ends are both among ``ids``.

    Edges are packed by either end. A step tells the driver of each node once at most.
    """
    from siftwright.operators.graph import cut

    spark, n, far = edges.sparkSession, len(ids), np.iinfo(np.int32).max
    if edges.count() <= ALONE:
        rows = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.lit(1.0)).toArrow().to_batches()
        known = list(_places(SimpleNamespace(value=ids))(rows))
        s, d, w = (np.concatenate([np.zeros(0, t), *(b.column(i).to_numpy() for b in known)]) for i, t in enumerate((np.int32, np.int32, np.float64)))
        into, out = _whole(d, s, w), _whole(s, d, w)
    else:
        into, out = _by(edges, "dst", "src", ids), _by(edges, "src", "dst", ids)
    first, place = out, np.arange(n, dtype=np.int32)
    there, component, packed = np.ones(n, bool), np.full(n, -1, np.int32), n
    while True:
        before = -1
        while before != np.count_nonzero(there):
            before = np.count_nonzero(there)
            for side in (into, out):
                at, _ = step(side, there, _held, np.int8)
                there = np.zeros(n, bool)
                there[at] = True
        if not before:
            break
        if before <= packed // 2:
            (into, out), packed = _shrink([into, out], there), before
        colour = _spread(into, np.where(there, place, far), np.where(there, 0, -1).astype(np.int32))
        # a node gets its own colour back only if it reaches the root
        mark = _spread(out, np.where(colour == place, place, far), colour)
        found = mark != far
        component[found] = mark[found]
        there = there & ~found
    size = np.bincount(component[component >= 0], minlength=n)
    component[(component >= 0) & (size[component] < least)] = -1
    if isinstance(first, list):
        in_one = np.flatnonzero(component >= 0)
        return spark.createDataFrame(pa.table({"id": ids[in_one], "component": ids[component[in_one]]}), "id long, component long")
    return cut(first.select("s").mapInArrow(_members(spark.sparkContext.broadcast((ids, component))), "id long, component long"))


def _rings(c, s, d):
    """(component, cycles): for whole components, given as edges from s to d of component c."""
    nodes, at = np.unique(np.concatenate([s, d]), return_inverse=True)
    s, d = at[: len(c)], at[len(c) :]
    order = np.argsort(s, kind="stable")
    names, c = np.unique(c, return_inverse=True)
    of = np.empty(len(nodes), np.int64)
    of[s], of[d] = c, c
    d, first = d[order], np.searchsorted(s[order], np.arange(len(nodes) + 1))
    root = np.unique(of, return_index=True)[1]
    parent, seen = np.full(len(nodes), -1), np.zeros(len(nodes), bool)
    end, length = np.full(len(names), -1), np.zeros(len(names), np.int64)
    seen[root], front, hops = True, root, 0
    while len(front):
        hops += 1
        # a front is in the order of its paths, so the first edge to a node is that of the smallest one
        by, e = _out(first, front)
        to = d[e]
        back = to == root[of[to]]
        closed, at = np.unique(of[to[back]], return_index=True)
        end[closed], length[closed] = front[by[back][at]], hops
        go = ~back & ~seen[to] & (length[of[to]] == 0)
        node, at = np.unique(to[go], return_index=True)
        by = by[go][at]
        seen[node], parent[node] = True, front[by]
        front = node[np.lexsort((node, by))]
    done = np.flatnonzero(length)
    stop = np.append(0, np.cumsum(length[done]))
    flat = np.empty(stop[-1], np.int64)
    node, at = end[done], stop[1:] - 1
    while len(node):
        flat[at] = nodes[node]
        up = parent[node] >= 0
        node, at = parent[node[up]], at[up] - 1
    return names[done], pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(flat))


def _cycles(batches):
    held: list = [np.zeros(0, np.int64)] * 3
    parts: list = []
    for b in batches:
        parts.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if sum(len(p[0]) for p in parts) + len(held[0]) < PACK:
            continue
        held, parts = [np.concatenate(c) for c in zip(held, *parts)], []
        end = np.searchsorted(held[0], held[0][-1])
        if end:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _rings(*(c[:end] for c in held)))), ["component", "cycle"])
            held = [c[end:] for c in held]
    held = [np.concatenate(c) for c in zip(held, *parts)]
    if len(held[0]):
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _rings(*held))), ["component", "cycle"])


def cycles(inner: DataFrame) -> DataFrame:
    """(component, cycle) as ``graph.cycles`` says, over edges(c, src, dst) within components, each of which is worked through in one task."""
    rows = inner.select(F.col("c").cast("long"), F.col("src").cast("long"), F.col("dst").cast("long"))
    return rows.repartition("c").sortWithinPartitions("c").mapInArrow(_cycles, "component long, cycle array<long>")
