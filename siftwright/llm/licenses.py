"""License scans: fuzzy search for short notices.

A notice that occurs with at most ``e`` edits keeps at least one of ``e + 1`` pieces intact (pigeonhole). One
Aho-Corasick pass over the normalised words finds those exact pieces; around each, the regex library's
bounded-error matching verifies the whole notice and gives its span and number of edits. Notices that stand
unedited all stay; of edited ones that overlap, the one with the least share of edits does. The notices are a table: the one given, or NOTICES. The contract's own
phrases are found as consecutive words.

Text is normalised to its words (a-z after lowering A-Z, digits, all beyond ASCII) with one blank between them.

Bytes that aren't UTF-8 are read as one unknown sign each.

Defined results. A null text counts as empty. Every input row gives a row, repeated rows and null ids too.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_pieces
from .notices import NOTICES

#: Phrases of the contract and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Most notices of a table: it's held by every task.
MAX_NOTICES = 20_000
#: One edit for each so many characters of a notice.
CHARS_PER_EDIT = 10

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def edits(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): e + 1 pieces that cover the notice."""
    n = edits(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Search:
    """The automaton of the pieces of all notices, and a pattern for each notice."""

    def __init__(self, notices: dict[str, str] | None = None):
        table: dict[str, str] = {}
        for notice, label in (NOTICES if notices is None else notices).items():
            if key := " ".join(w.decode() for w in notice.encode().translate(_WORDS).split()):
                table.setdefault(key, label)
        seeds: dict[str, list] = {}
        for at, notice in enumerate(table):
            for offset, piece in pieces(notice):
                seeds.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece in {*seeds, *table}:
            self.automaton.add_word(piece, (len(piece), seeds.get(piece, []), piece if piece in table else None))
        self.automaton.make_automaton()
        self.notices, self.labels = list(table.items()), table
        self.letters = [Counter(n) for n in table]
        self.patterns = [regex.compile(f"(?be)(?:{regex.escape(n, special_only=True)}){{e<={edits(n)}}}") for n in table]

    def fuzzy(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, length of the notice) in the normalised text."""
        if not self.notices:
            return []
        hits = list(self.automaton.iter(text))
        # a notice as it stands outdoes every edited one that overlaps it; one that doesn't has a piece of its own elsewhere
        found = [(end + 1 - size, end + 1, self.labels[notice], 0, size) for end, (size, _, notice) in hits if notice]
        exact = np.zeros(len(text) + 1, bool) if found else None
        for a, b, *_ in found:
            exact[a:b] = True
        done = [0] * len(self.notices)
        for end, (size, where, _) in hits:
            if exact is not None and exact[end + 1 - size : end + 1].any():
                continue
            for at, offset in where:
                notice, label = self.notices[at]
                e = edits(notice)
                a = max(done[at], end + 1 - size - offset - e)
                b = end + 1 - size - offset + len(notice) + e
                if b <= a:
                    continue
                # an edit makes up for one letter of the notice that the window lacks
                if sum((self.letters[at] - Counter(text[a:b])).values()) > e:
                    continue
                if m := self.patterns[at].search(text, a, b):
                    found.append((m.start(), m.end(), label, sum(m.fuzzy_counts), len(notice)))
                    done[at] = m.end()
        return sorted(set(found))


def _least_edited(found: list) -> list:
    """Of overlapping spans with edits the best, and none that overlaps one without; in the order of their places."""
    exact = sorted(x[:2] for x in found if not x[3])
    starts, ends = [a for a, _ in exact], list(accumulate((b for _, b in exact), max))
    kept: list = []
    for x in sorted((x for x in found if x[3]), key=lambda x: (x[3] / x[4], -x[4], x[0])):
        at = bisect_left(starts, x[1])
        if at and ends[at - 1] > x[0]:
            continue
        at = bisect_right(kept, x[:2])
        if not (at and kept[at - 1][1] > x[0] or at < len(kept) and kept[at][0] < x[1]):
            kept.insert(at, x)
    return sorted(kept + [x for x in found if not x[3]])


def scan_text(text: bytes | None, search: Search) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans (start:end word:label:edits)."""
    words = text.translate(_WORDS).split() if text else []
    if not words:
        return 0, 0, None, None, "", "", 0.0, ""
    joined = b" " + b" ".join(words) + b" "
    n_base, first, last, base = 0, None, None, set()
    for phrase, label in PHRASES.items():
        key = f" {phrase} ".encode()
        seen = blanks = 0  # blanks before ``seen``
        at = joined.find(key)
        while at >= 0:
            blanks += joined.count(b" ", seen, at)
            seen = at
            n_base, first, last = n_base + 1, min(blanks, blanks if first is None else first), max(blanks, last or 0)
            base.add(label)
            at = joined.find(key, at + 1)
    plain = joined.decode("utf-8", "replace")
    found = _least_edited(search.fuzzy(plain))
    spans = []
    if found:
        blanks = [i for i, c in enumerate(plain) if c == " "]
        spans = [f"{max(bisect_right(blanks, a), 1) - 1}:{bisect_right(blanks, max(b - 1, a))}:{label}:{e}" for a, b, label, e, _ in found]
    score = 1.0 if n_base else max((1 - e / n for _, _, _, e, n in found), default=0.0)
    labels = base | {x[2] for x in found}
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, ",".join(spans)


_COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.string()}


_SEARCHES: dict[tuple, Search] = {}


def _search_of(notices: dict[str, str] | None) -> Search:
    """Made once a worker and table."""
    key = tuple(NOTICES.items()) if notices is None else tuple(notices.items())
    if key not in _SEARCHES:
        _SEARCHES.clear()
        _SEARCHES[key] = Search(notices)
    return _SEARCHES[key]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """A row for each document: words, places of the phrases, labels, score and fuzzy spans.

    ``notices``: labels by notice, or a table (notice, label) of MAX_NOTICES rows at most; nulls in it are ignored,
    of repeated notices the first by label counts.
    """
    if isinstance(notices, DataFrame):
        rows = notices.where("notice IS NOT NULL AND label IS NOT NULL").groupBy("notice").agg(F.min("label").alias("label")).orderBy("notice").limit(MAX_NOTICES + 1).collect()
        if len(rows) > MAX_NOTICES:
            raise ValueError(f"more than {MAX_NOTICES} notices")
        notices = {r.notice: r.label for r in rows}

    def run(batches):
        search = _search_of(notices)
        for batch in batches:
            for ids, texts in text_pieces(batch):
                rows = zip(*(scan_text(t, search) for t in texts), strict=True)
                columns = [pa.array(c, t) for c, t in zip(rows, _COLUMNS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["id", *_COLUMNS])

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
