"""Relational core: lookups, references, imports, diffs and pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.operators.ranking import match_quality


def lookup(symbols: DataFrame, name: str, query: str, rank: str, key: str, limit: int = 20) -> DataFrame:
    """Symbols whose name matches: exact, then prefix, then anywhere; better ranks first within a tier."""
    hits = symbols.withColumn("tier", match_quality(F.col(name), query)).where(F.col("tier").isNotNull())
    return hits.orderBy("tier", F.col(rank).desc(), key).limit(limit)


def suffix_match(files: DataFrame, path: str, asked: str) -> DataFrame:
    """Files with the asked path, else those that end in it at a slash; '' and over-long paths match nothing."""
    asked = asked.removeprefix("./").rstrip("/")
    if not asked or len(asked) > 1024:
        return files.limit(0)
    hit = F.when(F.col(path) == asked, 0).when(F.endswith(F.col(path), F.lit(f"/{asked}")), 1)
    ranked = files.withColumn("match", hit).where(F.col("match").isNotNull())
    best = ranked.agg(F.min("match").alias("best"))
    return ranked.join(F.broadcast(best), F.col("match") == F.col("best")).drop("best")


def impact(refs: DataFrame, chunks: DataFrame, files: DataFrame, target: str, limit: int = 50) -> DataFrame:
    """Callers of a name, files of better rank first. refs(target, chunk_id), chunks(chunk_id, file_id), files(file_id, rank)."""
    calls = refs.where(F.col("target") == target)
    return calls.join(chunks, "chunk_id").join(files, "file_id").orderBy(F.col("rank").desc(), "chunk_id").limit(limit)


def definition_kind(n: Column) -> Column:
    """How sure a reference is, by the number of definitions of its name."""
    return F.when(n == 1, "DIRECT").when(n > 1, "UNCERTAIN").otherwise("INFERRED")


def god_nodes(refs: DataFrame, target: str, file: str, defined: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Most used names: references * sqrt(distinct files), of names that ``defined`` holds."""
    if defined is not None:
        refs = refs.join(defined, target, "left_semi")
    stats = refs.groupBy(target).agg(F.count("*").alias("refs"), F.count_distinct(file).alias("files"))
    return stats.withColumn("score", F.col("refs") * F.sqrt("files")).orderBy(F.col("score").desc(), target).limit(limit)


def orphans(symbols: DataFrame, refs: DataFrame, name: str, target: str, exclude: Column | None = None) -> DataFrame:
    """Symbols that no reference names, by full or bare (after the last dot) name."""
    used = refs.select(F.col(target).alias("__t")).distinct()
    out = symbols if exclude is None else symbols.where(~exclude)
    out = out.join(used, F.col(name) == F.col("__t"), "left_anti")
    return out.join(used, F.substring_index(name, ".", -1) == F.col("__t"), "left_anti")


def dangling(removed: DataFrame, refs: DataFrame, name: str, target: str, limit: int = 20) -> DataFrame:
    """Removed names with the number of references left; those without any count 0."""
    count = refs.join(removed.select(F.col(name).alias(target)).distinct(), target, "left_semi").groupBy(target).agg(F.count("*").alias("refs"))
    return removed.join(count.withColumnRenamed(target, name), name, "left").fillna(0, ["refs"]).orderBy(F.col("refs").desc(), name).limit(limit)


def max_fan_in(edges: DataFrame, src: str, dst: str, exclude: Column | None = None) -> DataFrame:
    """One row: the node with most distinct sources."""
    rows = edges if exclude is None else edges.where(~exclude)
    count = rows.select(src, dst).distinct().groupBy(dst).agg(F.count("*").alias("fan_in"))
    return count.orderBy(F.col("fan_in").desc(), dst).limit(1)


def layer_edges(edges: DataFrame, src_dir: str, dst_dir: str, weight: Column) -> DataFrame:
    """Directory pairs with their edges and weights, inner edges left out."""
    return edges.where(F.col(src_dir) != F.col(dst_dir)).groupBy(src_dir, dst_dir).agg(F.count("*").alias("edges"), F.sum(weight).alias("weight"))


def layer_grades(pairs: DataFrame, src_dir: str, dst_dir: str) -> DataFrame:
    """(dir, fan_out, fan_in, grade 1 to 5): a layer that depends on many and serves few grades low."""
    out = pairs.groupBy(F.col(src_dir).alias("dir")).agg(F.count_distinct(dst_dir).alias("fan_out"), F.lit(0).cast("long").alias("fan_in"))
    into = pairs.groupBy(F.col(dst_dir).alias("dir")).agg(F.lit(0).cast("long").alias("fan_out"), F.count_distinct(src_dir).alias("fan_in"))
    both = out.union(into).groupBy("dir").agg(F.sum("fan_out").alias("fan_out"), F.sum("fan_in").alias("fan_in"))
    return both.withColumn("grade", 5 - (F.col("fan_out") / (F.col("fan_in") + F.col("fan_out") + 1)) * 4)


def grade(score: Column) -> Column:
    """Letter of a score out of 5."""
    return F.when(score >= 4.5, "A").when(score >= 3.5, "B").when(score >= 2.5, "C").when(score >= 1.5, "D").otherwise("F")


def histogram(df: DataFrame, key: str) -> DataFrame:
    """(key, n, share): counts and their share of all rows."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def graph_summary(edges: DataFrame, src: str, dst: str) -> DataFrame:
    e = F.count("*")
    return edges.agg(e.alias("edges"), F.count_distinct(src).alias("sources"), F.count_distinct(dst).alias("targets"), (e / F.count_distinct(src)).alias("avg_out"), (e / F.count_distinct(dst)).alias("avg_in"))


def symbol_diff(old: DataFrame, new: DataFrame, keys: list[str], body: str) -> DataFrame:
    """(keys, change): added, removed, changed or same."""
    a = old.select(*keys, F.struct(body).alias("o"))
    b = new.select(*keys, F.struct(body).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def duplicates(symbols: DataFrame, name: str, file: str, least: int = 2) -> DataFrame:
    """Names defined in several files."""
    return symbols.groupBy(name).agg(F.count_distinct(file).alias("files"), F.min(file).alias("first_file"), F.max(file).alias("last_file")).where(F.col("files") >= least)


def shared_pins(memories: DataFrame, id_col: str, pins: Column, sha: str, order: str) -> DataFrame:
    """(older, newer, shared): pairs of rows that share a pin and stem from different commits.

    The pairing is an equi-join on the pin. Two unknown commits count as different.
    """
    rows = memories.select(F.col(id_col).alias("id"), F.col(sha).alias("sha"), F.col(order).alias("at"), F.explode(F.array_distinct(pins)).alias("pin"))
    a, b = rows.alias("a"), rows.alias("b")
    before = (F.col("a.at") < F.col("b.at")) | ((F.col("a.at") == F.col("b.at")) & (F.col("a.id") < F.col("b.id")))
    differ = ~(F.col("a.sha").isNotNull() & F.col("a.sha").eqNullSafe(F.col("b.sha")))
    pairs = a.join(b, (F.col("a.pin") == F.col("b.pin")) & before & differ)
    return pairs.groupBy(F.col("a.id").alias("older"), F.col("b.id").alias("newer")).agg(F.count("*").alias("shared"))


def similar_sets(rows: DataFrame, id_col: str, members: str, least: float) -> DataFrame:
    """(id, class_id, links): rows by equal sets, and with how many other rows a set's similarity is ``least`` or more.

    Equal sets fall into one class first, so a group of copies is one row from here on. Classes with a Jaccard
    similarity of t share one of their n - ceil(t n) + 1 rarest members (prefix filter), which is what they meet by; each
    pair is then counted on the whole sets. ``links`` counts rows, those of the own class but itself too. An empty set
    is linked with nothing, a null one with nothing and in no class.
    """
    from siftwright.operators.graph import cut

    sets = rows.select(F.col(id_col).alias("id"), F.sort_array(F.array_distinct(F.col(members))).alias("set")).withColumn("print", F.struct(F.xxhash64("set"), F.hash("set"), F.size("set")))
    classes = cut(sets.where("set IS NOT NULL").groupBy("print").agg(F.min("id").alias("class_id"), F.count("*").alias("rows"), F.min_by("set", "id").alias("set")))
    some = classes.where(F.size("set") > 0)
    each = some.select("class_id", F.explode("set").alias("m"))
    rare = each.join(each.groupBy("m").agg(F.count("*").alias("df")), "m")
    # the rarest members of each set, in one order for all sets
    order = rare.groupBy("class_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "m"))), lambda s: s["m"]).alias("by_df"))
    n = F.size("by_df")
    prefix = cut(order.select("class_id", n.alias("n"), F.posexplode(F.slice("by_df", F.lit(1), n - F.ceil(F.lit(least) * n - 1e-9).cast("int") + 1)).alias("at", "m")))
    a, b = (prefix.select(F.col("class_id").alias(x), F.col("n").alias(f"n{x}"), (F.col("n") - F.col("at")).alias(f"left{x}"), "m") for x in "ab")
    # at the rarest member that two sets share, as many as they must share are left in each
    enough = F.least("lefta", "leftb") >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = a.join(b, "m").where(enough & (F.col("a") < F.col("b")) & (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)).select("a", "b").distinct()
    left, right = (some.select(F.col("class_id").alias(x), F.col("set").alias(f"set_{x}"), F.col("rows").alias(f"rows_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    sure = pairs.join(left, "a").join(right, "b").where(both >= least * (F.size("set_a") + F.size("set_b") - both) - 1e-9)
    ends = F.array(F.struct(F.col("a").alias("class_id"), F.col("rows_b").alias("n")), F.struct(F.col("b").alias("class_id"), F.col("rows_a").alias("n")))
    links = sure.select(F.explode(ends).alias("e")).groupBy("e.class_id").agg(F.sum("e.n").alias("others"))
    total = classes.join(links, "class_id", "left").select("print", "class_id", F.when(F.size("set") == 0, 0).otherwise(F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("links"))
    return sets.join(total, "print", "left").select(F.col("id").alias(id_col), F.when(F.col("set").isNotNull(), F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


#: Places of a bucket in which intervals and points meet.
BUCKET = 64


def _spread(df: DataFrame, start: str, end: str, name: str, width: int) -> DataFrame:
    """A row for each bucket that an interval touches; an interval that ends before it starts touches none."""
    return df.where(F.col(end) >= F.col(start)).withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def as_of(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, value: str, width: int = BUCKET, tie: list[str] | None = None) -> DataFrame:
    """The value of the interval with the latest start that holds each point; points without one keep null.

    Of intervals with one start that is the first by the columns ``tie``. Points meet the intervals of their own bucket of ``width`` places, not all of their key.
    """
    there = _spread(intervals, start, end, "__b", width)
    hit = points.withColumn("__b", F.floor(F.col(at) / width)).join(there, [key, "__b"], "left").withColumn("__in", (F.col(start) <= F.col(at)) & (F.col(end) >= F.col(at)))
    order = F.struct(-F.col(start), *(F.col(c) for c in tie or [value]))
    return hit.groupBy(key, at).agg(F.min_by(F.when(F.col("__in"), F.col(value)), F.when(F.col("__in"), order)).alias(value))


def within(found: DataFrame, expected: DataFrame, key: str, a: str, b: str, tolerance: int) -> DataFrame:
    """Pairs of one key whose numbers differ by at most ``tolerance``.

    The range becomes an equality of buckets as wide as the tolerance; each found row looks into three of them.
    """
    width = tolerance + 1
    left = found.withColumn("__b", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(F.col(a) / width) + i)))
    right = expected.withColumn("__b", F.floor(F.col(b) / width))
    return left.join(right, [key, "__b"]).where(F.abs(F.col(a) - F.col(b)) <= tolerance).drop("__b")


def overlaps(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], width: int = BUCKET) -> DataFrame:
    """Pairs of one key whose spans share a place; both ends count.

    Spans meet in the buckets of ``width`` places that both touch; a pair counts in the first of those.
    """
    left, right = _spread(a, *a_span, "__b", width), _spread(b, *b_span, "__b", width)
    first = F.greatest(F.floor(F.col(a_span[0]) / width), F.floor(F.col(b_span[0]) / width))
    meet = (F.col(a_span[1]) >= F.col(b_span[0])) & (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col("__b") == first)
    return left.join(right, [key, "__b"]).where(meet).drop("__b")


#: What an import may leave out of a path, in the order in which it's tried.
SUFFIXES = ("", ".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json", ".py", ".rb", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.vue", "/__init__.py")


def resolve_imports(imports: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(source, spec, target): relative imports against known paths, the first candidate that exists.

    imports(source, spec), files(path). ``spec`` is relative to the directory of ``source``; '.' and '..' are
    folded by an in-row fold over its parts. Dotted modules (.a, ..a.b) count their dots from the package up.
    """
    dots = F.regexp_extract("spec", "^(\\.+)(?:[A-Za-z_]|\\z)", 1)
    dotted = F.concat(F.when(F.length(dots) == 1, "./").otherwise(F.repeat(F.lit("../"), F.length(dots) - 1)), F.replace(F.regexp_replace("spec", "^\\.+", ""), F.lit("."), F.lit("/")))
    asked = imports.withColumn("given", F.col("spec")).withColumn("spec", F.when(dots != "", dotted).otherwise(F.col("spec")))
    dirs = F.filter(F.split(F.regexp_replace("source", "/?[^/]*\\z", ""), "/"), lambda p: p != "")
    parts = F.filter(F.split("spec", "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, dirs, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    base = asked.withColumn("base", F.array_join(folded, "/"))
    bases = F.array_distinct(F.array(F.regexp_replace("base", "\\.(js|jsx|mjs)\\z", ""), F.col("base")))
    names = F.flatten(F.transform(bases, lambda b: F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.concat(b, s))))
    each = base.select("source", F.col("given").alias("spec"), F.posexplode(names).alias("i", "path"))
    return each.join(files.select("path"), "path").groupBy("source", "spec").agg(F.min_by("path", "i").alias("target"))


def resolve_packages(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, spec, target): dotted or slashed packages against path suffixes, the first path in order wins."""
    stem = F.regexp_replace("path", "\\.[A-Za-z0-9]+\\z", "")
    parts = F.split(stem, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    index = files.select("path", F.explode(ends).alias("key")).groupBy("key").agg(F.min("path").alias("target"))
    asked = imports.where(~F.endswith("spec", F.lit("*"))).withColumn("key", F.replace(F.col("spec"), F.lit("."), F.lit("/")))
    return asked.join(index, "key").select("source", "spec", "target")


def related_tests(files: DataFrame) -> DataFrame:
    """(source, test): files named like tests of another file (x_test, test_x, x.test, x.spec), any directory."""
    base = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(base, "\\.[A-Za-z0-9]+\\z", "")
    tested = F.coalesce(*(F.nullif(F.regexp_extract(stem, p, 1), F.lit("")) for p in ("^test_(.+)\\z", "^(.+)_test\\z", "^(.+)\\.(?:test|spec)\\z", "^(.+)Tests?\\z")))
    tests = files.select(F.col("path").alias("test"), tested.alias("key")).where("key IS NOT NULL")
    sources = files.select(F.col("path").alias("source"), stem.alias("key"), tested.isNull().alias("plain")).where("plain").drop("plain")
    return sources.join(tests, "key").select("source", "test")


def test_map(changed: DataFrame, files: DataFrame, edges: DataFrame, is_test: Column) -> DataFrame:
    """(source, test, how): tests of changed files(path), by name (any folder) or else because they import the file.

    files(path), edges(src, dst); a file without any test has one row with nulls. ``is_test`` is over ``path``.
    """
    asked = changed.select("path").distinct()
    named = related_tests(files).join(asked.withColumnRenamed("path", "source"), "source", "left_semi").withColumn("how", F.lit("name"))
    tests = files.where(is_test).select(F.col("path").alias("src"))
    imported = edges.join(tests, "src", "left_semi").join(asked.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("dst").alias("source"), F.col("src").alias("test")).distinct()
    imported = imported.join(named, ["source", "test"], "left_anti").withColumn("how", F.lit("import"))
    found = named.unionByName(imported)
    return asked.withColumnRenamed("path", "source").join(found, "source", "left").select("source", "test", "how")
