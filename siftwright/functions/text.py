"""Text expressions: tokens, identifiers, paths, token estimates. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a question.
STOP_WORDS = ("a", "an", "and", "are", "at", "by", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to", "what", "where", "which", "with")


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters and digits of any script. Null gives an empty array."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def identifier_parts(name: Column) -> Column:
    """Lower-case parts of a camelCase or snake_case name."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def query_tokens(query: Column, cap: int = 10) -> Column:
    """Distinct identifier parts of a question without stop words, at most ``cap``."""
    words = F.array_distinct(F.filter(identifier_parts(query), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))
    return F.slice(words, 1, cap)


def token_estimate(text: Column) -> Column:
    """About how many model tokens a text has: a token for each 3.5 characters."""
    return F.ceil(F.length(text) / F.lit(3.5))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """The part before the last slash; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*\\z", "")


def top_dirs(path: Column, depth: int = 2) -> Column:
    """The first ``depth`` directories of a path; '.' at the top."""
    parts = F.slice(F.split(path, "/"), 1, F.least(F.lit(depth), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))))
    return F.coalesce(F.nullif(F.array_join(parts, "/"), F.lit("")), F.lit("."))


def common_prefix_dir(paths: Column) -> Column:
    """The longest directory prefix that all paths of an array share."""

    def shared(acc: Column, path: Column) -> Column:
        dirs = F.split(dir_name(path), "/")
        n = F.least(F.size(acc), F.size(dirs))
        differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(acc, i - 1) != F.get(dirs, i - 1))
        return F.slice(acc, 1, F.coalesce(F.get(differ, F.lit(0)) - 1, n))

    start = F.split(dir_name(F.get(paths, F.lit(0))), "/")
    return F.array_join(F.aggregate(paths, start, shared), "/")


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text contains any of the words."""
    return reduce(lambda x, y: x | y, (F.contains(text, F.lit(w)) for w in words))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\\n\\s*\\n"), lambda p: F.trim(p) != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, "(?<=[.!?])\\s+"), lambda s: F.trim(s) != "")


def url_host(url: Column) -> Column:
    """Host of an address in lower case, without a leading 'www.'."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def referrer_bucket(url: Column, own_hosts: tuple[str, ...] = ()) -> Column:
    """Class of a referring address: direct, self, hn, reddit, x, github, google or other."""
    host = url_host(url)
    out = F.when(url.isNull() | (url == ""), "direct").when(host.isin(*own_hosts) if own_hosts else F.lit(False), "self")
    for bucket, pattern in (("hn", "(^|\\.)ycombinator\\.com\\z"), ("reddit", "(^|\\.)reddit\\.com\\z"), ("x", "(^|\\.)(x|twitter)\\.com\\z|^t\\.co\\z"), ("github", "(^|\\.)github\\.(com|io)\\z"), ("google", "(^|\\.)google\\.[a-z.]+\\z")):
        out = out.when(host.rlike(pattern), bucket)
    return out.otherwise("other")


def clean_url(url: Column, cap: int = 256) -> Column:
    """Host and path without query or fragment, at most ``cap`` characters."""
    return F.substring(F.concat(url_host(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), 1, cap)
