from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from siftwright.llm import common, minhash


def brute(rows, k, percent):
    sets, root = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def run(docs, **args):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, **args).collect()}


def corpus(rng):
    rows, i = [], 0
    for group in range(12):
        base = prose(rng, rng.choice([4, 30, 120])).split()
        for _ in range(rng.choice([1, 3, 9])):
            w = list(base)
            for _ in range(rng.randrange(len(w) // 20 + 1)):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append((i, " ".join(w)))
            i += 1
    # a chain: each is close to the next only, and a big group around it
    base = prose(rng, 200, 5000).split()
    for step in range(25):
        w = list(base)
        w[4 * step : 4 * step + 8] = [f"c{step}_{j}" for j in range(8)]
        rows.append((i, " ".join(w)))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "One two"), (i + 3, "one TWO"), (i + 4, "one\ttwo three"), (i + 5, "ÉTÉ one"), (i + 6, "été one")]
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups_match_brute_force(make, k, percent):
    rows = corpus(random.Random(11))
    assert run(make(rows), k=k, percent=percent) == brute(rows, k, percent)


def test_a_hot_bucket_with_stragglers(make):
    rng = random.Random(2)
    base = prose(rng, 150, 5000).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    assert run(make(rows), k=3, percent=85) == brute(rows, 3, 85)


def test_odd_rows(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[None] == [(2, None, True)] and by[1] == [(0, 1, True)] and by[6] == [(1, 6, True)] * 2 and by[7] == [(1, 6, False)]
    assert minhash.near_duplicates(none).count() == 0


def test_super_minhash_fills_every_register_and_estimates(spark):
    rng = np.random.default_rng(1)
    common_ = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    a, b = (np.concatenate([common_, rng.integers(0, 1 << 63, 20, dtype=np.uint64)]) for _ in range(2))
    sig = minhash.super_minhash([a, b, a[:1]], 120)
    assert (sig < np.uint64(120 << 32)).all()
    assert abs((sig[0] == sig[1]).mean() - 80 / 120) < 0.15
    # one element alone gives each register another level
    assert sorted(sig[2] >> np.uint64(32)) == list(range(120))


def test_bitmap_bound_never_loses_a_pair():
    rng = np.random.default_rng(4)
    for n in (1, 7, 100, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[len(x) // 10 :], rng.integers(0, 1 << 63, len(x) // 20, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        true = 100 * both >= 85 * (len(x) + len(y) - both)
        kept = minhash._bounded(np.array([0]), np.array([0]), np.array([len(x)]), np.array([len(y)]), [minhash.bitmap(x)], [minhash.bitmap(y)], 85, 100)
        assert kept[0] or not true


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(200, 260)}


def test_stragglers_whose_short_registers_collide_are_paired():
    rng = np.random.default_rng(6)
    bands = minhash.bands_for(0.85)
    sets = []
    for _ in range(3000):
        both = rng.integers(0, 1 << 63, 94, dtype=np.uint64)
        sets += [np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 6, dtype=np.uint64)])) for _ in range(2)]
    reg = np.concatenate([minhash.super_minhash(sets[i : i + 500], bands * minhash.ROWS) for i in range(0, len(sets), 500)])
    key = np.zeros((len(sets), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(minhash.ROWS):
        key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) + reg[:, r :: minhash.ROWS])
    short = (common.mix64(reg) >> np.uint64(56)).astype(np.uint8)
    entry = [{"id": i, "n": len(sets[i]), "label": i, "in_main": i % 2 == 0, "bands": key[i].view(np.int64).tolist(), "sig": short[i].tobytes(), "bits": minhash.bitmap(sets[i])} for i in range(len(sets))]
    # every bucket that a pair meets in, as the query packs it
    met = [(band, i) for i in range(0, len(sets), 2) for band in np.flatnonzero(key[i] == key[i + 1]).tolist()]
    shape = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("in_main", pa.bool_()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary()), ("bits", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([b for b, _ in met]), pa.array([[entry[i], entry[i + 1]] for _, i in met], shape), pa.array([[entry[i + 1]] for _, i in met], shape)], names=["band", "members", "stragglers"])
    got = [pair for out in minhash._cross(85, 100, 0.5)([batch]) for pair in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    assert sorted(got) == sorted({(i, i + 1) for _, i in met})
    # and the short registers of some do collide before the first shared band
    alike = (short[::2] == short[1::2]).reshape(-1, bands, minhash.ROWS).all(2).argmax(1)
    assert (alike != (key[::2] == key[1::2]).argmax(1)).any()
