"""Line dedup by site-relative frequency, in DataFrame operations only.

For each host, the pages that contain a line are divided by the host's pages; a line whose share exceeds RATIO
and that stands on LEAST pages of the host or more is boilerplate there and is dropped from all its pages. The
rule is the same for hosts of every size: on a host of three pages, what all of them share goes. A line is
compared without leading and trailing blanks; blank lines are always kept.

A host has at most (mean lines a page) / RATIO boilerplate lines, so one array holds them. The arrays are
broadcast if their counted total is within MAX_BROADCAST lines, and joined by host otherwise.

Counts are partial sums by (host, line) before the shuffle, so a hot host or line costs one row a task.

Defined results. Null text: stays null, counts as a page without lines. A null host is a host of its own. A
repeated row counts as another page. Other columns stay as they are, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free

RATIO = 0.1
#: Pages of a host that must hold a line: a share of few pages says little.
LEAST = 3
MAX_BROADCAST = 200_000
_BLANKS = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANKS)))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, line key, pages with the line, pages of the host) of the lines beyond the ratio."""
    rows = docs.select(host.alias("host"), text.alias("text"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda s: F.btrim(s, F.lit(_BLANKS)) != ""), _key))
    # the page itself counts under a null key, so one aggregation gives both counts
    keys = F.concat(F.array(F.lit(None).cast("long")), F.coalesce(lines, F.array().cast("array<long>")))
    counts = cut(rows.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where((F.col("n") >= least) | F.col("key").isNull()), "line-counts")
    pages = counts.where("key IS NULL").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    found = counts.where("key IS NOT NULL").join(pages, F.col("host").eqNullSafe(F.col("h")))
    return found.where(F.col("n") > ratio * F.col("pages")).select("host", "key", "n", "pages")


def drop_lines(docs: DataFrame, host_col: str | Column = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST, stats: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``; with ``stats``, also n_lines and n_dropped."""
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    found = cut(boilerplate(docs, host, F.col(text_col), ratio, least), "line-found")
    h, on, keys = free(docs, "__host", "__on", "__keys")
    of_host = found.groupBy(F.col("host").alias(h)).agg(F.collect_list("key").alias(keys))
    if found.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        of_host = F.broadcast(of_host)
    joined = docs.withColumn(on, host).join(of_host, F.col(on).eqNullSafe(F.col(h)), "left")
    lines = F.split(text_col, "\n", -1)
    kept = F.filter(lines, lambda s: ~F.array_contains(keys, _key(s)) | (F.btrim(s, F.lit(_BLANKS)) == ""))
    text = F.when(F.col(keys).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if stats:
        n = F.coalesce(F.size(lines), F.lit(0))
        out += [n.cast("long").alias("n_lines"), F.when(F.col(keys).isNull() | F.col(text_col).isNull(), 0).otherwise(n - F.size(kept)).cast("long").alias("n_dropped")]
    return joined.select(out)


def site(url: Column) -> Column:
    """Host of a page's address, lower case; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


#: The same over ``documents`` in SQL, for the query op4_line_freq.
SQL = rf"""
WITH t AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT DISTINCT doc_id, source, trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS l FROM (SELECT doc_id, source, unnest(ls) AS l FROM t)),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT e.source, l FROM e JOIN p USING (source) WHERE l <> '' GROUP BY e.source, l, pages HAVING count(*) > {RATIO} * pages AND count(*) >= {LEAST}),
x AS (SELECT doc_id, source, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM t),
k AS (SELECT x.doc_id, x.i, x.l, b.l IS NOT NULL AS gone FROM x LEFT JOIN b ON x.source = b.source AND trim(x.l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) = b.l)
SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM k GROUP BY doc_id
"""
