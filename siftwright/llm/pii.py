"""PII by anchor expansion.

One Aho-Corasick pass over each text (A-Z lowered) finds the anchors: at-signs, plus signs, digits, URL schemes
and identifier cues. Local parsers expand each anchor to its boundaries and validate what they find: mail
addresses around at-signs, phone numbers from plus signs, network addresses and card numbers from the first
digit of a run, addresses behind schemes, account numbers behind cues.

Kinds of the base contract: email, ip, card, phone. Kinds that the method adds: url (with a user part or an
address as host), account (a cue followed by an identifier with a digit).

Defined results. A null text counts as empty. Every input row gives a row, repeated rows and null ids too.
Extra columns are ignored; an empty table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import str_pieces

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
CUES = ("account", "acct", "iban", "passport", "ssn", "user id", "userid", "customer id", "member id", "tax id", "driver license")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIGIT = re.compile(r"[0-9]")
_URL = re.compile(r"://(?:[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?::[0-9]+)?(?:/[^\s<>\"]*)?")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|id|#))?\x20?[:=#]?\x20?([A-Za-z0-9]+(?:[-\x20]?[A-Za-z0-9]*[0-9][A-Za-z0-9]*)*)", re.I | re.A)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", "@")
    a.add_word("+", "+")
    for digit in "0123456789":
        a.add_word(digit, "0")
    for scheme in ("http", "https", "ftp", "ssh"):
        a.add_word(f"{scheme}://", ("scheme", len(scheme)))
    for cue in CUES:
        a.add_word(cue, ("cue", len(cue)))
    a.make_automaton()
    return a


_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    """A-Z lowered, or all letters where that keeps every place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


_ANCHORS: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _alone(text: str, a: int, b: int) -> bool:
    return not (a and text[a - 1].isalnum() or b < len(text) and text[b].isalnum())


def find_pii(text: str) -> list[tuple[int, int, int]]:
    """(place of the kind in KINDS, start, end) of every span, sorted."""
    if not _ANCHORS:
        _ANCHORS.append(_automaton())
    found = []
    after = {"@": 0, "+": 0, "ip": 0, "card": 0}  # where the last match of the kind ends
    before = -2  # the digit before
    for end, value in _ANCHORS[0].iter(_lower(text)):
        if value == "0":
            first, before = end > before + 1, end
            # a match starts with a run of digits, whole or what the match before left of it
            if (first or end == after["ip"]) and end >= after["ip"] and (m := _IP.match(text, end)):
                after["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append((1, end, m.end()))
            if first and end >= after["card"] and (m := _CARD.match(text, end)):
                after["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, end, m.end()))
        elif value == "@":
            a, floor = end, after["@"]
            while a > floor and text[a - 1] in _LOCAL:
                a -= 1
            if a < end and (m := _DOMAIN.match(text, end + 1)):
                found.append((0, a, m.end()))
                after["@"] = m.end()
        elif value == "+":
            if end >= after["+"] and (m := _PHONE.match(text, end)):
                after["+"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((3, end, m.end()))
        elif value[0] == "scheme":
            a = end + 1 - 3 - value[1]
            if (m := _URL.match(text, end - 2)) and not (a and text[a - 1].isalnum()):
                found.append((4, a, m.end()))
        else:
            a = end + 1 - value[1]
            m = _ACCOUNT.match(text, end + 1)
            if m and (body := m[1].replace(" ", "").replace("-", "")) and 6 <= len(body) <= 34 and _DIGIT.search(body) and not (a and text[a - 1].isalnum()) and _alone(text, m.start(1), m.end(1)):
                found.append((5, m.start(1), m.end(1)))
    # the tail of an anchor may be the head of another ("https" holds "http"): equal spans count once
    return sorted(set(found))


def digest_row(text: str | None) -> tuple:
    found = find_pii(text) if text else []
    base = [s for s in found if s[0] < len(BASE_KINDS)]
    join = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
    return (*(sum(k == i for k, _, _ in base) for i in range(len(BASE_KINDS))), hashlib.sha256(join(base).encode()).hexdigest(), join(found), bool(found))


COUNTS = tuple(f"n_{k}" for k in BASE_KINDS)
_TYPES = {**dict.fromkeys(COUNTS, pa.int64()), "base_sha256": pa.string(), "spans": pa.string(), "has_pii": pa.bool_()}


def _digests(batches):
    for batch in batches:
        for ids, texts in str_pieces(batch):
            rows = zip(*map(digest_row, texts), strict=True)
            columns = [pa.array(c, t) for c, t in zip(rows, _TYPES.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["id", *_TYPES])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, their digest, all spans, and whether there is any."""
    schema = f"id long, {', '.join(f'{c} long' for c in COUNTS)}, base_sha256 string, spans string, has_pii boolean"
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_digests, schema)
    return out.withColumnRenamed("id", id_col)


def _redact(batches):
    for batch in batches:
        for ids, texts in str_pieces(batch):
            out = []
            for text in texts:
                if text:
                    at, parts = 0, []
                    for a, b, k in sorted((a, b, k) for k, a, b in find_pii(text)):
                        if a >= at:
                            parts += [text[at:a], f"<{KINDS[k].upper()}>"]
                            at = b
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "text"])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every span replaced by the name of its kind; of overlapping spans the first counts."""
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_redact, "id long, text string")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col))
