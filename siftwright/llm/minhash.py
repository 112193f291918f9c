"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find grouping.

SuperMinHash (Ertl, 2017) gives every shingle one random permutation of the registers; register values of
level ``j`` lie in ``[j, j+1)``, so that a document is finished at the first level at which all its registers
are filled (early stopping). The levels run over all documents of a chunk at once.

Documents with equal shingle sets are collapsed first. Of the rest, documents that share a band meet in a
bucket. Two members of each bucket (smallest id, smallest hash of id) are compared with all others; buckets
whose members are then still in different components have their stragglers compared with the rest, pack
against pack within a row: by signature, then by an exact bound from bitmaps of the whole sets. Pairs that pass
are verified on the sets themselves. No pair is made for a bucket whose members are already connected, so large groups cost
their size and not its square.

Defined results. Null or blank text: an empty set, linked with nothing, its own component. A null id: links
nothing, component null, kept. Repeated rows: each gives a row; links are between ids. An id with several texts
is linked where any of them is similar. Columns beside the id and text columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, lower_words, mix64, semi_ids, shingle_set, text_pieces

ROWS = 4
#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-7
#: Stragglers of a bucket that travel in one row; twice as many members.
PACK = 32


def bands_for(threshold: float, miss: float = MISS, rows: int = ROWS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Registers (documents x m, uint64: level << 32 | fraction) of non-empty shingle sets; m <= 255."""
    sizes = np.array([len(s) for s in sets])
    e, d = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    reg = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    perm = None
    for j in range(m):
        x = mix64(e + np.uint64((j + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            at = k
        else:
            rows = np.arange(len(e))
            at = perm[rows, k]
            perm[rows, k] = perm[:, j]
            perm[:, j] = at
        np.minimum.at(reg, d * m + at, (x >> np.uint64(32)) | np.uint64(j << 32))
        open_ = reg.reshape(-1, m).max(1) >= np.uint64((j + 1) << 32)
        left = open_[d]
        if not left.any():
            break
        e, d = e[left], d[left]
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
            k = k[left]
            perm[np.arange(len(e)), k] = 0
            perm[:, 0] = k
        else:
            perm = perm[left]
    return reg.reshape(-1, m)


def _signatures(k: int, bands: int):
    m = bands * ROWS

    def run(batches):
        for batch in batches:
            for ids, texts in text_pieces(batch):
                sets = [shingle_set(lower_words(t), k) for t in texts]
                some = [i for i, s in enumerate(sets) if len(s)]
                fp = np.zeros((len(sets), 2), np.uint64)
                keys, sig = [[]] * len(sets), [b""] * len(sets)
                if some:
                    reg = super_minhash([sets[i] for i in some], m)
                    joined = np.concatenate([sets[i] for i in some])
                    starts = np.cumsum([0, *(len(sets[i]) for i in some)])[:-1]
                    fp[some, 0] = np.add.reduceat(mix64(joined), starts)
                    fp[some, 1] = np.bitwise_xor.reduceat(mix64(joined + np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    key = np.zeros((len(some), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                    for r in range(ROWS):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + reg[:, r::ROWS])
                    short = (mix64(reg) >> np.uint64(56)).astype(np.uint8)
                    for at, i in enumerate(some):
                        keys[i], sig[i] = key[at].view(np.int64), short[at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(fp[:, 0].view(np.int64)),
                        pa.array(fp[:, 1].view(np.int64)),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(sig, pa.binary()),
                    ],
                    names=["id", "n", "fp1", "fp2", "bands", "sig"],
                )

    return run


def bitmap(shingles: np.ndarray) -> bytes:
    """Bits of the shingles' low ends, 8 to 16 bits for each shingle, a power of two in all."""
    size = max(64, 1 << (8 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for ids, texts in text_pieces(batch):
                sets = [shingle_set(lower_words(t), k) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(list(map(bitmap, sets)), pa.binary())], names=["id", "shingles", "bits"])

    return run


def _estimates(batches):
    """Rows (a, b, na, nb, sa, sb) -> (a, b, est): the share of equal registers."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint8).reshape(n, -1)
        b = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint8).reshape(n, -1)
        est = pa.array((a == b).mean(1))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), est], names=["a", "b", "est"])


def _verify(num: int, den: int):
    """Rows (a, b, sa, sb) with full sets -> the pairs with den * intersection >= num * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                s = np.concatenate([x, y])
                s.sort(kind="stable")
                both = int((s[1:] == s[:-1]).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(out.columns, names=["a", "b"])

    return run


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) as those of a smaller power of two."""
    while bits.shape[1] > size:
        bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
    return bits


def _bounded(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, bits_x: list, bits_y: list, num: int, den: int) -> np.ndarray:
    """Of the index pairs (a, b), those whose bitmaps allow for the similarity.

    A bit that only one bitmap has stands for a shingle, at least, that only that set has: an exact bound.
    """
    keep = np.zeros(len(a), bool)
    size_x, size_y = np.array([len(x) for x in bits_x]), np.array([len(y) for y in bits_y])
    for sx in set(size_x[a].tolist()):
        for sy in set(size_y[b].tolist()):
            here = np.flatnonzero((size_x[a] == sx) & (size_y[b] == sy))
            step = max(1, (1 << 22) // max(sx, sy))
            for part in (here[i : i + step] for i in range(0, len(here), step)):
                x = _fold(np.frombuffer(b"".join(bits_x[i] for i in a[part].tolist()), np.uint8).reshape(len(part), sx), sy)
                y = _fold(np.frombuffer(b"".join(bits_y[i] for i in b[part].tolist()), np.uint8).reshape(len(part), sy), sx)
                only_x, only_y = (np.bitwise_count(u & ~v).sum(1, dtype=np.int64) for u, v in ((x, y), (y, x)))
                nx, ny = n[a[part]], m[b[part]]
                both = np.minimum(nx - only_x, ny - only_y)
                keep[part] = den * both >= num * (nx + ny - both)
    return keep


def _cross(num: int, den: int, least: float):
    """Rows (band, pack of members, pack of stragglers) -> pairs to verify, each in the first band whose bucket it shares only."""

    def parts(column) -> tuple:
        """Offsets, and the ids, sizes, labels, main marks, signatures, band keys and bitmaps of all entries of a column of packs."""
        flat, ends = column.flatten(), column.value_lengths().to_numpy().cumsum()
        sig = np.frombuffer(b"".join(flat.field("sig").to_pylist()), np.uint8).reshape(len(flat), -1)
        keys = flat.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        return np.concatenate([[0], ends]), *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "label", "in_main")), sig, keys, flat.field("bits").to_pylist()

    def run(batches):
        # in slices: what is copied out of a batch isn't held for all of its packs
        for batch in (whole.slice(i, PACK) for whole in batches for i in range(0, whole.num_rows, PACK)):
            at_x, id_x, n_x, label_x, main_x, sig_x, keys_x, bits_x = parts(batch.column("members"))
            at_y, id_y, n_y, label_y, _, sig_y, keys_y, bits_y = parts(batch.column("stragglers"))
            out = []
            for r, band in enumerate(batch.column("band").to_pylist()):
                x, y = slice(at_x[r], at_x[r + 1]), slice(at_y[r], at_y[r + 1])
                i, j = id_x[x, None], id_y[None, y]
                n, m = n_x[x, None], n_y[None, y]
                # two stragglers meet from both sides: one of them counts
                good = (label_x[x, None] != label_y[None, y]) & (main_x[x, None] | (j < i)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
                a, b = np.nonzero(good)
                keep = (sig_x[x][a] == sig_y[y][b]).mean(1) >= least
                a, b = a[keep], b[keep]
                # by the keys of the buckets: the 8-bit registers of a band may be equal where its bucket isn't shared
                keep = (keys_x[x][a] == keys_y[y][b]).argmax(1) == band
                a, b = a[keep], b[keep]
                keep = _bounded(a, b, n_x[x], n_y[y], bits_x[x], bits_y[y], num, den)
                i, j = id_x[x][a[keep]], id_y[y][b[keep]]
                out.append((np.minimum(i, j), np.maximum(i, j)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose k-word shingle sets satisfy ``100 * |intersection| >= percent * |union|``.

    Returns a row per input row: id, n_shingles, component_id (smallest id reachable), kept (id = component_id).
    """
    threshold = percent / 100
    bands = bands_for(threshold)
    m = bands * ROWS
    # a register agrees with probability J; 5.5 standard deviations below the threshold
    least = threshold - 5.5 * math.sqrt(threshold * (1 - threshold) / m)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    every = cut(source.mapInArrow(_signatures(k, bands), "id long, n long, fp1 long, fp2 long, bands array<long>, sig binary"), "minhash-sig")
    reps = cut(
        every.where("n > 0 AND id IS NOT NULL").groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.min_by(F.struct("bands", "sig"), "id").alias("s")).select("fp1", "fp2", "n", F.col("rep").alias("id"), "s.bands", "s.sig"),
        "minhash-rep",
    )
    placed = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = placed.groupBy("band", "key").agg(F.min("id").alias("h1"), F.max("id").alias("h9"), F.min_by("id", F.xxhash64("id")).alias("h2")).where("h1 < h9").drop("h9")
    # cut before the join: both its sides are then shuffles of their own, which Spark can split where a bucket is hot
    members = cut(placed.join(cut(shared, "minhash-shared"), ["band", "key"]), "minhash-members")
    wanted = cut(members.select("id").distinct(), "minhash-wanted")
    # an id may have several texts: a pair is verified on each
    texts = semi_ids(source, "id", wanted, "id").withColumn("version", F.xxhash64("text")).dropDuplicates(["id", "version"]).select("id", "text")
    full = cut(texts.mapInArrow(_sets(k), "id long, shingles binary, bits binary"), "minhash-sets")
    small = cut(semi_ids(reps.select("id", "n", "bands", "sig"), "id", wanted, "id"), "minhash-small")

    def verified(pairs: DataFrame) -> DataFrame:
        left = full.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        right = full.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(_verify(percent, 100), "a long, b long")

    hubs = members.select(F.explode(F.array("h1", "h2")).alias("h"), "id").where("h <> id").select(F.least("h", "id").alias("a"), F.greatest("h", "id").alias("b")).distinct()
    left = small.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = small.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = hubs.join(right, "b").join(left, "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    likely = sized.mapInArrow(_estimates, "a long, b long, est double").where(F.col("est") >= least)
    links = cut(verified(likely), "minhash-links")
    comp = components(links)

    def labelled(comp: DataFrame) -> DataFrame:
        own = members.join(comp.withColumnRenamed("node", "id"), "id", "left").select("band", "key", "id", F.coalesce("comp", "id").alias("label"))
        return own

    # buckets whose members aren't all in one component: pairs of their stragglers with the rest
    own = labelled(comp)
    sums = cut(own.groupBy("band", "key", "label").agg(F.count("*").alias("c")), "minhash-sums")
    mixed = sums.groupBy("band", "key").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).where("all > most")
    open_ = own.join(mixed, ["band", "key"]).join(small, "id").join(full.select("id", "bits"), "id")
    open_ = cut(open_, "minhash-open")
    entry = F.struct("id", "n", "label", (F.col("label") == F.col("main")).alias("in_main"), "bands", "sig", "bits")

    def packed(rows: DataFrame, count, size: int, name: str) -> DataFrame:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(count / size)))
        return salted.groupBy("band", "key", "salt").agg(F.collect_list(entry).alias(name)).drop("salt")

    # both cut before they are joined: a hot bucket's packs are then dealt over many tasks
    stragglers = cut(packed(open_.where("label <> main"), F.col("all") - F.col("most"), PACK, "stragglers"), "minhash-stragglers")
    met = cut(packed(open_, F.col("all"), 2 * PACK, "members"), "minhash-packs").join(stragglers, ["band", "key"]).select("band", "members", "stragglers")
    likely = cut(met.mapInArrow(_cross(percent, 100, least), "a long, b long"), "minhash-cross")
    # cut first: no task then runs two Python workers, one behind the other
    comp = components(cut(links.union(verified(likely)), "minhash-links"))

    named = reps.select("fp1", "fp2", "n", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").select(F.col("fp1").alias("f1"), F.col("fp2").alias("f2"), F.col("n").alias("fn"), F.coalesce("comp", "id").alias("comp"))
    out = every.select("id", "n", "fp1", "fp2").join(named, (F.col("fp1") == F.col("f1")) & (F.col("fp2") == F.col("f2")) & (F.col("n") == F.col("fn")), "left")
    comp_id = F.when(F.col("id").isNotNull(), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("comp")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept"))
