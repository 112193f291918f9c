"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text). The ledger holds a row for each pair
of blob and rule version that has been scanned, with its findings. A run scans one carrier of each blob that
the ledger lacks under the current rules, appends it, and joins findings back to all versions that carry it.
The rule version is a checksum of the rules, so a changed rule scans every blob anew. Rows of one blob and rule
version are equal, and readers take one of them: runs at the same time, or a run again after a late failure,
may append a pair twice and change no result.

Defined results. A null text counts as empty. A null id is a path like any other. Repeated rows give a row
each and are scanned as one blob. An empty table gives an empty result and appends nothing. Extra columns are
ignored; positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, str_pieces

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "bearer", "jwt", "pem", "token")
#: Most rows of a broadcast list of versions that need no scan (about 100 bytes each).
BROADCAST_ROWS = 200_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# greedy runs: the length test within the pattern finds the same runs as one made afterwards
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MORE = (
    ("bearer", re.compile(r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}=*")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----")),
    ("token", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}")),
)
#: Blobs are scanned anew under every other set of rules.
RULE_VERSION = zlib.crc32(repr([(p.pattern, p.flags) for p in (_ASSIGN, _ACCESS, _HEX, *(x for _, x in _MORE))]).encode()) & 0x7FFFFFFF


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of every span, sorted."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for at, (_, pattern) in enumerate(_MORE, len(BASE_KINDS)):
        found += [(m.start(), at, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


SCAN_SCHEMA = "blob string, kinds array<string>, starts array<long>, ends array<long>"


def _scan(batches):
    for batch in batches:
        for blobs, texts in str_pieces(batch):
            rows = [find_secrets(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(blobs, pa.string()),
                    pa.array([[KINDS[k] for _, k, _ in r] for r in rows], pa.list_(pa.string())),
                    pa.array([[a for a, _, _ in r] for r in rows], pa.list_(pa.int64())),
                    pa.array([[b for _, _, b in r] for r in rows], pa.list_(pa.int64())),
                ],
                names=["blob", "kinds", "starts", "ends"],
            )


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger at a path; an empty table before the first run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    schema = f"{SCAN_SCHEMA}, rule_version int"
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger)


def address(versions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, blob, text) of every version."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return versions.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def update(versions: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """Scan what the ledger lacks, append it, and return the (id, blob) of every version."""
    spark = versions.sparkSession
    rows = address(versions, id_col, text_col)
    known = cut(rows.select("id", "blob"), "secrets-versions")
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob").distinct()
    # one row a blob before it meets the ledger, so a hot blob is summed where it lies
    todo = cut(known.groupBy("blob").agg(F.min("id").alias("id")).join(seen, "blob", "left_anti"), "secrets-todo")
    same = lambda a, b: a.id.eqNullSafe(b.id) & (a.blob == b.blob)
    skip = cut(known.join(todo, same(known, todo), "left_anti").distinct(), "secrets-skip")
    if skip.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        carriers = rows.join(F.broadcast(skip), same(rows, skip), "left_anti")
    else:
        carriers = rows.join(todo, same(rows, todo), "left_semi")
    # a row that stands twice in the table carries its blob twice
    found = carriers.select("blob", "text").mapInArrow(_scan, SCAN_SCHEMA).dropDuplicates(["blob"])
    found.withColumn("rule_version", F.lit(rule_version)).write.mode("append").parquet(ledger)
    return known


def _hits(known: DataFrame, ledger: str, rule_version: int) -> DataFrame:
    """The blobs with findings, each once. Cut, so that the join with a hot blob's versions can be split."""
    return cut(read_ledger(known.sparkSession, ledger).where((F.col("rule_version") == rule_version) & (F.size("kinds") > 0)).dropDuplicates(["blob"]), "secrets-hits")


def findings(known: DataFrame, ledger: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """A row for each version and finding: id, blob, kind, start, end."""
    hits = _hits(known, ledger, rule_version)
    each = F.explode(F.arrays_zip("kinds", "starts", "ends")).alias("f")
    return known.join(hits, "blob").select("id", "blob", each).select("id", "blob", F.col("f.kinds").alias("kind"), F.col("f.starts").alias("start"), F.col("f.ends").alias("end"))


def digest(known: DataFrame, ledger: str, id_col: str = "doc_id", rule_version: int = RULE_VERSION) -> DataFrame:
    """A row for each version: counts of the base kinds, their digest, and all spans."""
    hits = _hits(known, ledger, rule_version)
    spans = F.zip_with("kinds", F.zip_with("starts", "ends", lambda a, b: F.concat_ws(":", a, b)), lambda k, s: F.concat_ws(":", k, s))
    of = lambda kind: F.size(F.filter("kinds", lambda x: x == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("all", lambda s: F.substring_index(s, ":", 1).isin(*BASE_KINDS))
    hits = hits.withColumn("all", spans).select("blob", *map(of, BASE_KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join("all", ",").alias("spans"))
    out = known.join(hits, "blob", "left")
    zero = {f"n_{k}": 0 for k in BASE_KINDS} | {"base_sha256": hashlib.sha256(b"").hexdigest(), "spans": ""}
    return out.fillna(zero).select(F.col("id").alias(id_col), *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans")


def scan(versions: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """Bring the ledger up to date and give the digest of every version; without a path, a fresh ledger."""
    ledger = ledger or scratch(versions.sparkSession, "secrets-ledger")
    return digest(update(versions, ledger, id_col, text_col, rule_version), ledger, id_col, rule_version)
