"""Mixing to target weights with soft membership.

Domains come from the label table: toxic, junk (low quality) and clean. A naive Bayes classifier gives each
document a posterior over the domains from hashed word prefixes and binned statistics. It learns from the
LEARN_ROWS labelled documents with the smallest hash of their id (a documented bound), in FOLDS parts: which kinds of evidence
count, and how clear a piece of it must be, is what does best on the parts left out, and the log-odds of the
parts left out calibrate the posteriors (Platt scaling), so that soft totals are sums of chances.

Rates r from 0 to MAX_RATE minimise, by projected gradient from r = 1,

    1/2 sum_d w_d ((sum_i r_i t_i p_id - T_d) / N)^2

with tokens t, posteriors p, target totals T, N all tokens and w_d one over the domain's present share. A step changes a
document by its posteriors times one vector: the domain errors, scaled by the inverse Gram matrix of the
posteriors of documents whose rate is within its bounds, damped towards the plain gradient where that fails.
So the state of the whole iteration is the list of those vectors, and each pass over the posteriors sums a few
numbers by domain. A step must lower the sum of squares; the iteration ends once each total
is within CLOSE of its target, or no step lowers the sum by GAIN: the targets are then out of reach and ``mix``
warns with the totals achieved.

Defined results. Null or blank text: no tokens, the posterior of an empty document. Null ids get rates too.
Repeated rows are documents of their own. A domain without labelled rows has the odds of half a row against
the clean ones; without any labelled rows every posterior is even.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, text_pieces

DOMAINS = ("clean", "junk", "toxic")
#: Target shares of all tokens.
TARGETS = {"clean": 0.985, "junk": 0.01, "toxic": 0.005}
#: Bound of the labelled sample that the classifier learns from.
LEARN_ROWS = 20_000
FOLDS = 4
BUCKETS = 1 << 16
#: Four shares, binned finely and coarsely, have places of their own behind the hashed prefixes.
BINS = (40, 8)
SIZE = BUCKETS + 4 * sum(b + 1 for b in BINS)
#: Kinds of evidence, by their places.
KINDS = {"words": (0, BUCKETS), "shares": (BUCKETS, SIZE), "both": (0, SIZE)}
#: Signed roots of the likelihood ratio, about standard errors, by which a piece of evidence must speak for a domain.
CLEAR = (2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 8.0)
#: And how many times as often, at least, the domain's documents must hold it: a long text holds many weak signs.
STRONG = 10.0
VARIANTS = [(kind, clear) for kind in KINDS for clear in CLEAR]
#: Relative error of a domain's total at which it counts as met, and the least relative gain of a step.
CLOSE = 1e-4
GAIN = 1e-3
#: Levenberg-Marquardt damping: the first tried once an undamped step fails, and the last.
LEAST_DAMPING, MOST_DAMPING = 0.01, 100.0
#: No document is taken more often than this.
MAX_RATE = 8.0


_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#*$%&|<>~^=_{}[]\\/@+!?")] = True
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    return (mix64(x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> _SHIFT).astype(np.int64)


def _buckets(text: bytes | None) -> tuple[np.ndarray, int]:
    """Buckets of a document (prefixes of 4 and 6 bytes of its lowered words, binned shares), and its words.

    Prefixes are read off the byte array at the word starts, all words at once.
    """
    raw = np.frombuffer((text or b"") + b" ", np.uint8)
    low = np.frombuffer((text or b"").lower() + b" " * 8, np.uint8)
    blank = _BLANK[raw]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    n = len(starts)
    parts = []
    share = repeat = 0.0
    if n:
        sizes = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]])) - starts
        key = np.zeros(n, np.uint64)
        for j in range(6):
            key |= np.where(sizes > j, low[starts + j], 0).astype(np.uint64) << np.uint64(8 * j)
            if j == 3:
                parts.append(_hashed(key, 1))
        parts.append(_hashed(key, 2))
        word = key ^ (sizes.astype(np.uint64) << np.uint64(48))
        share = len(np.unique(word)) / n
        repeat = float((word[1:] == word[:-1]).sum()) / n
    count = np.bincount(raw, minlength=256)
    bins = (count[_UPPER].sum() / len(raw), count[_SIGNS].sum() / len(raw), share, repeat)
    at = BUCKETS
    for b in BINS:
        parts.append(np.array([at + i * (b + 1) + round(b * x) for i, x in enumerate(bins)]))
        at += len(bins) * (b + 1)
    return np.unique(np.concatenate(parts)), n


def _count(batches):
    """Rows (domain, fold, text) -> (domain, fold, bucket, documents); bucket SIZE counts all."""
    total = np.zeros((len(DOMAINS), FOLDS, SIZE + 1), np.int64)
    for batch in batches:
        folds = batch.column("fold").to_pylist()
        at = 0
        for domains, texts in text_pieces(batch):
            for d, t in zip(domains, texts, strict=True):
                total[d, folds[at], _buckets(t)[0]] += 1
                total[d, folds[at], SIZE] += 1
                at += 1
    d, f, b = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (d, f, b)] + [pa.array(total[d, f, b])], names=["domain", "fold", "bucket", "n"])


def _xlog(k: np.ndarray, even: np.ndarray) -> np.ndarray:
    """k log(k / even), 0 for k = 0."""
    return np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(even, 1e-300)), 0.0)


class Evidence:
    """Log-odds of a domain against clean from what speaks for it: buckets of a kind, so clear and strong."""

    def __init__(self, counts: np.ndarray, domain: int, kind: str, clear: float):
        """counts: (domains, SIZE + 1), the last column counting documents."""
        a, b = KINDS[kind]
        n = counts[:, SIZE].astype(float)
        c = counts[:, a:b] + 0.5
        share = c / (n[:, None] + 1)
        ratio = np.log(share[domain] / share[0])
        k, m = counts[[0, domain], a:b], n[[0, domain], None]
        even = k.sum(0) / max(m.sum(), 1) * m
        root = np.sqrt(np.maximum(2 * (_xlog(k, even) + _xlog(m - k, m - even)).sum(0), 0))
        good = (ratio > np.log(STRONG)) & (root > clear)
        self.weight = np.zeros(SIZE + 1)
        self.weight[a:b][good] = np.log(share[domain] / (1 - share[domain]) / (share[0] / (1 - share[0])))[good]
        self.start = float(np.log((n[domain] + 1) / (n[0] + 1)) + np.log((1 - share[domain]) / (1 - share[0]))[good].sum())

    def __call__(self, buckets: np.ndarray) -> float:
        return self.start + float(self.weight[buckets].sum())


def _stacked(evidence: list[Evidence]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, the place of each bucket among those that weigh anything (0: nothing), and the weights there."""
    weight = np.column_stack([e.weight for e in evidence])
    used = np.flatnonzero(weight.any(1))
    place = np.zeros(len(weight), np.int32)
    place[used] = np.arange(1, len(used) + 1)
    return np.array([e.start for e in evidence]), place, np.concatenate([np.zeros((1, weight.shape[1])), weight[used]])


def platt(odds: np.ndarray, yes: np.ndarray) -> tuple[float, float, float]:
    """Slope and start of the calibrated log-odds, and their log loss, by Newton steps on smoothed marks."""
    n1, n0 = int(yes.sum()), int((~yes).sum())
    t = np.where(yes, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(odds).max(initial=0)), 1e-9)
    x = np.column_stack([odds / scale, np.ones(len(odds))])
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(w):
        z = x @ w
        return float((np.logaddexp(0, z) - t * z).sum() + 1e-6 * (w @ w))

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - t) + 2e-6 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before = w - size * step, now
        now = loss(w)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return float(w[0] / scale), float(w[1]), now / max(len(odds), 1)


class Bayes:
    """A calibrated classifier: evidence for each domain but clean, with slope and start of its log-odds."""

    def __init__(self, n: np.ndarray):
        """n: labelled documents of each domain. What has no evidence keeps its odds by these counts."""
        self.prior = np.log((n + 0.5) / (n[0] + 0.5))
        self.parts: list[tuple[int, Evidence, float, float]] = []

    def posterior(self, buckets: np.ndarray) -> np.ndarray:
        odds = self.prior.copy()
        for d, evidence, slope, start in self.parts:
            odds[d] = slope * evidence(buckets) + start
        p = np.exp(np.clip(odds - odds.max(), -50, 0))
        return p / p.sum()


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = LEARN_ROWS) -> Bayes:
    """Learn from a bounded sample of the labelled documents; for a repeated label the worst domain counts."""
    spark = docs.sparkSession
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    known = labels.select(F.col(id_col).cast("long").alias("id"), domain.cast("int").alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL").groupBy("id").agg(F.max("domain").alias("domain"))
    # at most ``rows`` ids: a broadcast of bounded size
    picked = cut(known.orderBy(F.xxhash64("id"), "id").limit(rows), "mixing-picked")
    picked = F.broadcast(picked.select(F.col("id").alias("picked"), "domain", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = cut(source.join(picked, F.col("id") == F.col("picked")).select("domain", "text", "fold"), "mixing-sample")
    counts = np.zeros((len(DOMAINS), FOLDS, SIZE + 1), np.int64)
    for r in sample.mapInArrow(_count, "domain int, fold int, bucket int, n long").groupBy("domain", "fold", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.domain, r.fold, r.bucket] = r.n
    every = counts.sum(1)
    model = Bayes(every[:, SIZE].astype(float))
    found = [d for d in range(1, len(DOMAINS)) if every[d, SIZE] and every[0, SIZE]]
    if not found:
        return model
    # evidence learnt without a fold is tried on that fold
    tried = spark.sparkContext.broadcast([_stacked([Evidence(every - counts[:, f], d, *v) for d in found for v in VARIANTS]) for f in range(FOLDS)])

    def left_out(batches):
        for batch in batches:
            folds, at = batch.column("fold").to_pylist(), 0
            for domains, texts in text_pieces(batch):
                of = folds[at : at + len(texts)]
                at += len(texts)
                buckets = [_buckets(t)[0] for t in texts]
                odds = []
                for f, b in zip(of, buckets, strict=True):
                    start, place, weight = tried.value[f]
                    odds.append((start + weight[place[b]].sum(0)).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(domains, pa.int32()), pa.array(odds, pa.list_(pa.float64()))], names=["domain", "odds"])

    got = sample.mapInArrow(left_out, "domain int, odds array<double>").collect()  # ``rows`` short rows, or a few more where ids repeat
    tried.unpersist()
    got.sort(key=lambda r: (r.domain, r.odds))
    domains, odds = np.array([r.domain for r in got]), np.array([r.odds for r in got]).reshape(len(got), len(found), len(VARIANTS))
    for at, d in enumerate(found):
        some = (domains == 0) | (domains == d)
        tests = [platt(odds[some, at, v], domains[some] == d) for v in range(len(VARIANTS))]
        best = min(range(len(VARIANTS)), key=lambda v: tests[v][2])
        model.parts.append((d, Evidence(every, d, *VARIANTS[best]), max(tests[best][0], 0.0), tests[best][1]))
    return model


def posteriors(docs: DataFrame, model: Bayes, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens, p_<domain>...) of every document."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # its size is fixed by DOMAINS and BUCKETS

    def run(batches):
        for batch in batches:
            for ids, texts in text_pieces(batch):
                found = list(map(_buckets, texts))
                p = np.array([shared.value.posterior(b) for b, _ in found])
                tokens = [n for _, n in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.int64()), *(pa.array(p[:, d]) for d in range(len(DOMAINS)))], names=["id", "tokens", *(f"p_{d}" for d in DOMAINS)])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id long, tokens long, {', '.join(f'p_{d} double' for d in DOMAINS)}")


def rate(steps: list[list[float]]):
    """A document's rate after the given steps, as an expression over its posteriors."""
    if not steps:
        return F.lit(1.0)
    vectors = F.array(*(F.array(*map(F.lit, s)) for s in steps))

    def step(r, g):
        return F.least(F.lit(MAX_RATE), F.greatest(F.lit(0.0), r - sum((F.col(f"p_{d}") * g[i] for i, d in enumerate(DOMAINS)), F.lit(0.0))))

    return F.aggregate(vectors, F.lit(1.0), step)


@dataclass
class Plan:
    """The vectors of the steps, the domains' shares of all tokens that they achieve and should, and whether each is met."""

    steps: list[list[float]]
    achieved: dict[str, float]
    wanted: dict[str, float]
    met: bool


def solve(p: DataFrame, targets: dict[str, float]) -> Plan:
    """Projected gradient over the posteriors ``p``, until the targets are met or no step lowers the error.

    Targets are shares of all tokens; a domain without one may come out at any total.
    """
    n_domains = len(DOMAINS)
    named = np.array([d in targets for d in DOMAINS])
    whole = sum(targets[d] for d in DOMAINS if d in targets)
    wanted = np.array([targets.get(d, 0.0) / whole for d in DOMAINS])
    pairs = [(i, j) for i in range(n_domains) for j in range(i, n_domains)]

    def totals(steps):
        """Shares of the domains at the rates of ``steps``, and the Gram matrix of what is within its bounds."""
        q = p.select(F.col("tokens").alias("t"), *(f"p_{d}" for d in DOMAINS), rate(steps).alias("r"))
        free = F.when((F.col("r") > 0) & (F.col("r") < MAX_RATE), F.col("t")).otherwise(0)
        row = q.agg(F.sum("t"), *(F.sum(F.col("t") * F.col("r") * F.col(f"p_{d}")) for d in DOMAINS), *(F.sum(free * F.col(f"p_{DOMAINS[i]}") * F.col(f"p_{DOMAINS[j]}")) for i, j in pairs)).first()
        n = float(row[0] or 0)
        if not n:
            return None, None
        gram = np.zeros((n_domains, n_domains))
        for (i, j), v in zip(pairs, row[1 + n_domains :], strict=True):
            gram[i, j] = gram[j, i] = v / n
        return np.array(row[1 : 1 + n_domains]) / n, gram

    cost = lambda share: float((weight * (share - wanted) ** 2)[named].sum())
    met = lambda share: bool((np.abs(share - wanted) <= CLOSE * np.maximum(wanted, 1e-6))[named].all())
    steps: list[list[float]] = []
    share, gram = totals(steps)
    if share is None:
        return Plan([], dict.fromkeys(DOMAINS, 0.0), {d: w for d, w, given in zip(DOMAINS, wanted.tolist(), named, strict=True) if given}, True)
    weight = 1 / np.maximum(share, 1e-6)
    damping = 0.0
    while not met(share):
        better = False
        while not better and damping <= MOST_DAMPING:
            # undamped: what would meet the targets if no rate met a bound; damped: nearer to the plain gradient, and shorter
            g = np.zeros(n_domains)
            g[named] = np.linalg.solve((gram + damping * np.diag(1 / weight) + 1e-12 * np.eye(n_domains))[named][:, named], (share - wanted)[named])
            # twelve digits: the order in which tasks are summed doesn't show
            step = [float(f"{x:.12g}") for x in g]
            new, new_gram = totals([*steps, step])
            better = cost(new) < cost(share) * (1 - GAIN)
            damping = damping / 8 if better else max(damping * 8, LEAST_DAMPING)
        if not better:
            break
        steps.append(step)
        share, gram = new, new_gram
    return Plan(steps, dict(zip(DOMAINS, share.tolist(), strict=True)), {d: w for d, w, given in zip(DOMAINS, wanted.tolist(), named, strict=True) if given}, met(share))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: tokens, posteriors, likeliest domain, rate, and copies.

    ``copies`` is the rate rounded down, plus one with the chance of what is left; the chance is a hash of the
    id, so it's the same in every run. Warns if the targets are out of reach.
    """
    p = cut(posteriors(docs, fit(docs, labels, id_col, text_col), id_col, text_col), "mixing-posteriors")
    plan = solve(p, targets)
    if not plan.met:
        warnings.warn(f"target shares {plan.wanted} are out of reach; the nearest rates achieve {plan.achieved}", stacklevel=2)
    best = F.greatest(*(f"p_{d}" for d in DOMAINS))
    domain = F.coalesce(*(F.when(F.col(f"p_{d}") == best, F.lit(d)) for d in DOMAINS))
    chance = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    out = p.withColumn("rate", rate(plan.steps)).withColumn("domain", domain)
    return out.select(F.col("id").alias(id_col), "tokens", *(f"p_{d}" for d in DOMAINS), "domain", "rate", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"))
