"""Source trees as tables: scan, ignore rules, languages, snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.text import content_hash

LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp",
    "rb": "ruby", "php": "php", "kt": "kotlin", "scala": "scala", "swift": "swift", "dart": "dart", "ex": "elixir", "exs": "elixir", "lua": "lua",
    "zig": "zig", "hs": "haskell", "clj": "clojure", "ml": "ocaml", "md": "markdown", "ipynb": "notebook", "vue": "vue",
}
MAX_BYTES = 1_000_000
#: Folders and files that hold no source of their own.
DEFAULT_IGNORE = (
    *(f"{d}/" for d in "node_modules .git .hg .svn dist build out target vendor Pods .gradle .next .nuxt .svelte-kit __pycache__ .pytest_cache .mypy_cache .tox .venv venv env .cache coverage".split()),
    *("*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".env", ".DS_Store", "Thumbs.db"),
    *(f"*.{e}" for e in "wasm png jpg jpeg gif ico svg webp woff woff2 ttf eot mp3 mp4 avi mov pdf zip tar gz 7z exe dll so dylib bin dat db sqlite class jar pyc o a".split()),
)
#: Files at the root of a tree whose lines are ignore rules, in the order in which they are read.
IGNORE_FILES = (".gitignore", ".aiderignore", ".siftignore")


def glob_regex(pattern: str) -> str:
    """A gitignore pattern (without '!') as a regular expression over relative paths."""
    folder = pattern.endswith("/")
    body = pattern.rstrip("/")
    rooted = "/" in body
    out, i = "", 0
    body = body.lstrip("/")
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if rooted else "(?:^|/)") + out + ("/" if folder else "(?:/|\\z)")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches a path ignores it; '!' takes a path back in."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if rule and not rule.startswith("#"):
            out = F.when(path.rlike(glob_regex(rule.removeprefix("!"))), F.lit(not rule.startswith("!"))).otherwise(out)
    return out


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)\\z", 1))
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), ext)


def ignore_rules(spark: SparkSession, root: str) -> list[str]:
    """The rules in the ignore files at the root of a tree: at most a few lines, read by the driver."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []
    for name in IGNORE_FILES:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = path.getFileSystem(conf)
        if fs.exists(path):  # spark.read leaves names with a leading dot out
            stream = fs.open(path)
            try:
                out += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            finally:
                stream.close()
    return out


def listing(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, language, mtime, size) of the source files below a folder. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.expr(f"substring(path, instr(path, '{root.rstrip('/')}/') + {len(root.rstrip('/')) + 1})")
    rows = files.select(rel.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    rows = rows.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & (F.col("size") <= max_bytes))
    return rows.where(~ignored(F.col("path"), [*DEFAULT_IGNORE, *ignore_rules(spark, root), *(ignore or [])])).select("path", "language", "mtime", "size")


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, language, mtime, size, hash, text). Files over the limit are pruned before they are read."""
    keep = listing(spark, root, ignore, max_bytes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    rel = F.expr(f"substring(path, instr(path, '{root.rstrip('/')}/') + {len(root.rstrip('/')) + 1})")
    text = files.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"))
    return keep.join(text, "path").withColumn("hash", content_hash(F.col("text")))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", version: str = "mtime") -> DataFrame:
    """(path, change): added, changed, removed or same, by one full join."""
    a = old.select(key, F.col(version).alias("o"), F.lit(True).alias("in_old"))
    b = new.select(key, F.col(version).alias("n"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def freshness(index: DataFrame, tree: DataFrame) -> DataFrame:
    """One row: how many files are dirty, missing and new."""
    return snapshot_diff(index, tree).agg(*(F.sum((F.col("change") == c).cast("long")).alias(n) for c, n in (("changed", "dirty"), ("removed", "missing"), ("added", "new"), ("same", "fresh"))))


def weights(path: Column, rules: list[tuple[str, float]], code: Column | None = None) -> Column:
    """Weight of a path: the last glob that matches, within 0 and 10; else 1, or 0.1 where it isn't code."""
    out = F.lit(1.0) if code is None else F.when(code, 1.0).otherwise(0.1)
    for glob, w in rules:
        out = F.when(path.rlike(glob_regex(glob)), F.lit(min(max(float(w), 0.0), 10.0))).otherwise(out)
    return out
