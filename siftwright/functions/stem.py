"""Porter's stemmer (1980) over Arrow batches, for search over English words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_C, _V = "[^aeiou]", "[aeiouy]"
_CS, _VS = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
_M0 = re.compile(f"^(?:{_CS})?{_VS}{_CS}")
_M1 = re.compile(f"^(?:{_CS})?{_VS}{_CS}(?:{_VS})?$")
_M2 = re.compile(f"^(?:{_CS})?{_VS}{_CS}{_VS}{_CS}")
_HAS_V = re.compile(f"^(?:{_CS})?{_V}")
_CVC = re.compile(f"^{_CS}{_V}[^aeiouwxy]$")
_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


@lru_cache(1 << 17)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    first_y = w[0] == "y"
    if first_y:
        w = "Y" + w[1:]
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    elif (m := re.match("^(.+?)(ed|ing)$", w)) and _HAS_V.match(m[1]):
        w = m[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"([^aeiouylsz])\1$", w):
            w = w[:-1]
        elif _CVC.match(w):
            w += "e"
    if w.endswith("y") and _HAS_V.match(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _M0.match(w[: -len(end)]):
                    w = w[: -len(end)] + table[end]
                break
    for end in _STEP4:
        if w.endswith(end):
            if _M2.match(w[: -len(end)]):
                w = w[: -len(end)]
            break
    else:
        if w.endswith(("sion", "tion")) and _M2.match(w[:-3]):
            w = w[:-3]
    if w.endswith("e"):
        s = w[:-1]
        if _M2.match(s) or _M1.match(s) and not _CVC.match(s):
            w = s
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return "y" + w[1:] if first_y else w


@lru_cache(1 << 17)
def fold(w: str) -> str:
    """Letters without their marks: é as e."""
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def _stems(batches):
    for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
        lists = [[stem(fold(w)) for w in ws] for ws in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.string()))], names=["id", "stems"])


def stems(words: DataFrame, id_col: str, words_col: str) -> DataFrame:
    """(id, stems) of word arrays, letters folded before."""
    return words.select(F.col(id_col).cast("long").alias("id"), F.coalesce(words_col, F.array().cast("array<string>"))).mapInArrow(_stems, "id long, stems array<string>")
