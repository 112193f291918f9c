"""Graph operators over an edge table (src, dst, weight)."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.operators import dense

#: Steps of a loop between two tables that end its lineage.
STRIDE = 4

_own: list[str] = []
_made: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of a loop: written under spark.checkpoint.dir (shared by all executors) and read back.

    Only in local mode may that setting be absent; a temporary folder is used then.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="siftwright-graph-"))
        base = _own[0]
    path = f"{base.rstrip('/')}/siftwright/graph-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables of all loops of this process. Call it once the results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, tolerance: float | None = 1e-4) -> DataFrame:
    """(id, rank), the best rank being 1. nodes(id), edges(src, dst), parallel edges counting separately.

    Teleport is (1 - d) / n; ranks of nodes without out-edges are not handed on; edges with an unknown end are
    dropped. Stops at ``iterations`` or once no rank moves by ``tolerance``. Parallel edges are merged first,
    so that a step moves one row an edge, summed by target before the shuffle.
    """
    ids = nodes.select("id").distinct()
    if dense.fits(nodes.schema["id"].dataType, edges.schema["src"].dataType, edges.schema["dst"].dataType):
        known = dense.node_ids(ids)
        if known is not None and len(known):
            links = dense.places(edges.select(F.col("dst").alias("s"), F.col("src").alias("d"), F.lit(1.0).alias("w")), known)
            rank = dense.pagerank(known, links, iterations, damping, tolerance)
            return edges.sparkSession.createDataFrame(pa.table({"id": known, "rank": rank}), "id long, rank double")
    known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    merged = known.groupBy("src", "dst").agg(F.count("*").alias("m"))
    out = merged.groupBy("src").agg(F.sum("m").alias("deg"))
    links = cut(merged.join(out, "src").select("src", "dst", (F.col("m") / F.col("deg")).alias("share")))
    n = ids.count()
    if n == 0:
        return ids.withColumn("rank", F.lit(1.0))
    ranks, done = ids.withColumn("rank", F.lit(1.0 / n)), 0
    while done < iterations:
        # several steps in one plan; how far the last of them moved is read off the table that they end in
        for _ in range(min(STRIDE, iterations - done)):
            got = links.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("inflow"))
            step = ranks.join(got, F.col("id") == F.col("dst"), "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("inflow", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
            ranks, done = step.select("id", "rank"), done + 1
        step = cut(step)
        ranks = step.select("id", "rank")
        if tolerance is not None and step.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
            break
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.join(F.broadcast(top)).select("id", (F.col("rank") / F.col("top")).alias("rank"))


def label_propagation(edges: DataFrame, iterations: int = 20) -> DataFrame:
    """(id, label) by weighted votes of the neighbours, until no node would change its label.

    A node keeps its label where no other has more votes, else takes the strongest, of equals the smallest. As
    neighbours that change together would swap labels for ever, each of the ``iterations`` moves about half of the nodes, by a
    hash of node and round, and then the others: what settles is what updates in place, one node after the
    other, leave as it is.
    """
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).where("src <> dst AND weight > 0")
    if dense.fits(edges.schema["src"].dataType, edges.schema["dst"].dataType):
        ids = dense.node_ids(both.select(F.col("src").alias("id")).distinct())
        if ids is not None and len(ids):
            return dense.label_propagation(ids, dense.places(both.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("weight").alias("w")), ids), iterations)
    both = cut(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = cut(both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))

    def voted(labels: DataFrame) -> DataFrame:
        """(id, old, best): each node's label and the one that it would take."""
        votes = both.join(labels, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id"), F.col("label").alias("vote")).agg(F.round(F.sum("weight"), 9).alias("w"))
        return votes.join(labels, "id").groupBy("id").agg(F.first("label").alias("old"), F.max_by("vote", F.struct("w", (F.col("vote") == F.col("label")).alias("own"), -F.col("vote"))).alias("best"))

    for turn in range(iterations):
        early = F.crc32(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(turn)))) % 2 == 0
        half = voted(labels).select("id", F.when(early, F.col("best")).otherwise(F.col("old")).alias("label"), (F.col("best") != F.col("old")).alias("restless"))
        rest = voted(half.select("id", "label")).select("id", F.when(early, F.col("old")).otherwise(F.col("best")).alias("new"))
        step = cut(half.join(rest, "id").select("id", F.col("new").alias("label"), "restless"))
        labels = step.select("id", "label")
        if step.where("restless").isEmpty():
            break
    return labels


def clusters(nodes: DataFrame, edges: DataFrame, iterations: int = 20, least: int = 3) -> DataFrame:
    """(id, cluster, size, total, hub): communities of a graph with node ranks. nodes(id, rank).

    Groups under ``least`` join the large group to which their edges weigh most, else stay; nodes without
    edges are left out. Clusters are numbered from 1 by descending sum of ranks; the hub has the best rank.
    """
    labels = label_propagation(edges, iterations)
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    sized = labels.join(size, "label")
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    small = sized.where(F.col("n") < least).select(F.col("id").alias("src"), F.col("label").alias("small"))
    large = sized.where(F.col("n") >= least).select(F.col("id").alias("dst"), F.col("label").alias("large"))
    pull = both.join(small, "src").join(large, "dst").groupBy("small", "large").agg(F.sum("weight").alias("w")).where("w > 0")
    moves = pull.groupBy("small").agg(F.max_by("large", F.struct("w", -F.col("large"))).alias("large"))
    final = labels.join(moves, F.col("label") == F.col("small"), "left").select("id", F.coalesce("large", "label").alias("label"))
    ranked = final.join(nodes.select("id", "rank"), "id", "left")
    sums = ranked.groupBy("label").agg(F.count("*").alias("size"), F.sum("rank").alias("total"), F.max_by("id", F.struct("rank", -F.col("id"))).alias("hub"))
    from siftwright.operators.ranking import running

    numbered = running(sums, [], [F.col("total").desc(), F.col("label")], F.lit(1), "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    return final.join(numbered, "label").select("id", "cluster", "size", "total", "hub")


#: Ids that are broadcast to pick rows; beyond that both sides are shuffled.
FEW = 1_000_000


def _rows_of(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``key`` is among ``ids``(id), a table that was cut: broadcast if it was counted to be small."""
    ids = ids.select(F.col("id").alias(key))
    return rows.join(F.broadcast(ids) if ids.count() <= FEW else ids, key, "left_semi")


def bfs(seeds: DataFrame, edges: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(id, depth): nodes within ``depth`` hops of the seeds and their least depth. One join a hop, of the edges at the front alone."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    hop = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return _hops(seeds, depth, lambda front: _rows_of(hop, "a", front).select(F.col("b").alias("id")))


def bfs_groups(seeds: DataFrame, members: DataFrame, depth: int) -> DataFrame:
    """``bfs`` where all members of a group are linked, members(group, id), without a row for each pair of them."""
    return _hops(seeds, depth, lambda front: _rows_of(members, "group", cut(_rows_of(members, "id", front).select(F.col("group").alias("id")).distinct())).select("id"))


def _hops(seeds: DataFrame, depth: int, reach) -> DataFrame:
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        front = cut(reach(front).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.union(front)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both in ``nodes``(id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def boundary(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges among the seeds and their neighbours one hop away in either direction."""
    ids = seeds.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    into = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return induced(edges, ids.union(out).union(into))


def _spread(links: DataFrame, start: DataFrame) -> DataFrame:
    """Least label that reaches each node: start(id, label), links(a -> b). Null stands for no label yet."""
    now = start
    while True:
        old = now.withColumnRenamed("label", "first")
        for _ in range(STRIDE):
            got = links.join(now.where("label IS NOT NULL"), F.col("a") == F.col("id")).groupBy("b").agg(F.min("label").alias("via"))
            now = now.join(got, F.col("id") == F.col("b"), "left").select("id", F.least("label", "via").alias("label"))
        step = cut(now.join(old, "id").select("id", "label", (~F.col("label").eqNullSafe(F.col("first"))).alias("moved")))
        now = step.select("id", "label")
        if step.where("moved").isEmpty():
            return now


def scc(edges: DataFrame, least: int = 2) -> DataFrame:
    """(id, component): strongly connected components of ``least`` nodes or more, named by a member.

    Forward colouring: every node takes the least id that reaches it. Within a colour, the nodes that reach its
    root form a component; they leave, and the rest goes round again. Nodes without in- or out-edges are
    trimmed in each round.
    """
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    kind = edges.schema["src"].dataType
    if dense.fits(kind, edges.schema["dst"].dataType):
        ids = dense.node_ids(cut(left.select(F.col("src").alias("id")).distinct()))
        if ids is not None:
            return dense.scc(ids, left, least).select(F.col("id").cast(kind), F.col("component").cast(kind))
    found = None
    while True:
        while True:
            before = left.count()
            if not before:
                break
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if left.count() == before:
                break
        if not before or left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
        colour = _spread(left.select(F.col("src").alias("a"), F.col("dst").alias("b")), nodes)
        same = left.join(colour.select(F.col("id").alias("src"), F.col("label").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("cd")), "dst").where("cs = cd")
        back = same.select(F.col("dst").alias("a"), F.col("src").alias("b"))
        # a node gets its own colour back only if it reaches the root
        mark = _spread(back, colour.select("id", F.when(F.col("id") == F.col("label"), F.col("label")).alias("label")))
        part = cut(mark.where("label IS NOT NULL").select("id", F.col("label").alias("component")))
        found = part if found is None else found.union(part)
        left = cut(left.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0)
    size = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    return found.join(size, "component", "left_semi").select("id", "component")


def new_cycles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Components of ``after`` that hold no component of ``before`` as a subset: (component, size)."""
    size = before.groupBy(F.col("component").alias("old")).agg(F.count("*").alias("n"))
    shared = before.select("id", F.col("component").alias("old")).join(after.select("id", "component"), "id").groupBy("old", "component").agg(F.count("*").alias("k"))
    holds = shared.join(size, "old").where("k = n").select("component").distinct()
    return after.join(holds, "component", "left_anti").groupBy("component").agg(F.count("*").alias("size"))


def fan_in_spikes(before: DataFrame, after: DataFrame, threshold: int = 50) -> DataFrame:
    """Nodes whose in-degree crosses the threshold: (id, fan_in_before, fan_in_after)."""
    count = lambda e, name: e.select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias(name))
    old, new = count(before, "fan_in_before"), count(after, "fan_in_after")
    joined = new.where(F.col("fan_in_after") >= threshold).join(old, "id", "left").fillna(0, ["fan_in_before"])
    return joined.where(F.col("fan_in_before") < threshold).select("id", "fan_in_before", "fan_in_after")


def apply_edits(edges: DataFrame, edited: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Replace the out-edges of edited nodes(id)."""
    kept = edges.select("src", "dst").join(edited.select(F.col("id").alias("src")), "src", "left_anti")
    return kept.unionByName(new_edges.select("src", "dst")).distinct()


def cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, cycle): a shortest cycle through the least member of each component, as an array from that member on.

    components(id, component) by ``scc``. Paths grow by a hop at a time within a component, one a node: the
    one over the smallest nodes. Ends once every component has its cycle. Components with whole numbers as ids
    are each done by one task; those of more than ``dense.ALONE`` edges, or with other ids, grow over tables.
    """
    inner = edges.select("src", "dst").where("src <> dst").distinct()
    inner = inner.join(components.select(F.col("id").alias("src"), F.col("component").alias("c")), "src").join(components.select(F.col("id").alias("dst"), F.col("component").alias("d")), "dst").where("c = d")
    inner = cut(inner.select("c", "src", "dst"))
    if not dense.fits(*(components.schema[c].dataType for c in ("id", "component")), *(edges.schema[c].dataType for c in ("src", "dst"))):
        return _cycles(inner, components)
    large = [r.c for r in inner.groupBy("c").count().where(F.col("count") > dense.ALONE).collect()]
    is_large = F.col("c").isin(large)
    kinds = [components.schema["component"].dataType, T.ArrayType(components.schema["id"].dataType)]
    found = dense.cycles(inner.where(~is_large)).select(*(F.col(c).cast(k) for c, k in zip(("component", "cycle"), kinds)))
    return found.union(_cycles(cut(inner.where(is_large)), components.where(F.col("component").isin(large)))) if large else found


def _cycles(inner: DataFrame, components: DataFrame) -> DataFrame:
    root = components.groupBy(F.col("component").alias("c")).agg(F.min("id").alias("root"))
    front = cut(root.select("c", "root", F.col("root").alias("node"), F.array("root").alias("path")))
    seen, done = front.select("c", "node"), None
    while not front.isEmpty():
        grown = cut(front.join(inner.withColumnRenamed("src", "node"), ["c", "node"]).select("c", "root", F.col("dst").alias("node"), "path"))
        closed = cut(grown.where("node = root").groupBy("c").agg(F.min("path").alias("cycle")))
        done = closed if done is None else done.union(closed)
        open_ = grown.where("node <> root").join(done.select("c"), "c", "left_anti").join(seen, ["c", "node"], "left_anti")
        front = cut(open_.groupBy("c", "root", "node").agg(F.min("path").alias("path")).withColumn("path", F.concat("path", F.array("node"))))
        seen = seen.union(front.select("c", "node"))
    empty = components.select(F.col("component").alias("c"), F.array("id").alias("cycle")).limit(0)
    return (empty if done is None else done).select(F.col("c").alias("component"), "cycle")


def layers(edges: DataFrame) -> DataFrame:
    """(id, level): length of the longest path into each node; nodes on or behind a cycle get no level (-1).

    Nodes without edges into them leave level by level, so there are as many steps as levels.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    left = cut(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    done, level = None, 0
    while True:
        split = cut(left.join(e.select(F.col("dst").alias("id")).distinct().withColumn("held", F.lit(True)), "id", "left"))
        now, left = split.where("held IS NULL").select("id"), split.where("held").select("id")
        if now.isEmpty():
            break
        part = now.withColumn("level", F.lit(level))
        done = part if done is None else done.union(part)
        e = cut(e.join(now.withColumnRenamed("id", "src"), "src", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(-1))
    return rest if done is None else done.union(rest)
