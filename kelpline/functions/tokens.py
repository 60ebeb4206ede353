"""The search tokeniser: case folded, without diacritics, split at what is neither letter nor digit."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Letters that have a base letter of one character, and these base letters."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and len(base) == 1:
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


FOLD = _fold_table()


def _by_alphabet(text: Column, read: Callable[[Column, str], Column]) -> Column:
    """read(text, class of token characters). Combining marks that stand alone are dropped first; ASCII text has none, nor letters to fold."""
    text = F.coalesce(text, F.lit(""))
    plain = F.translate(F.lower(F.regexp_replace(text, r"\p{Mn}+", "")), *FOLD)
    return F.when(F.octet_length(text) == F.length(text), read(F.lower(text), "a-z0-9")).otherwise(read(plain, r"\p{L}\p{N}\p{Co}"))


def tokens(text: Column) -> Column:
    """Tokens in order."""
    return _by_alphabet(text, lambda plain, letters: F.regexp_extract_all(plain, F.lit(f"([{letters}]+)"), 1))


def cuttable(text: Column) -> Column:
    """What ``cut`` takes: ASCII text as it is, other text as its tokens with spaces between them."""
    joined = F.regexp_replace(F.translate(F.lower(F.regexp_replace(text, r"\p{Mn}+", "")), *FOLD), r"[^\p{L}\p{N}\p{Co}]+", " ")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(joined)


#: ASCII letters, lower-cased, digits and bytes of other characters; 0 for what stands between tokens.
_WITHIN = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b * (b >= 128) for b in range(256)], np.uint8)


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All tokens of the texts in order, each with its text's number and its place in that text."""
    texts = texts.fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    low = _WITHIN.take(data)
    inside = low != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = bounds[bounds < len(low)]  # a text begins anew
    begin[edges] = inside[edges]
    first, kept = np.flatnonzero(begin), low[inside]
    ends = np.append(np.flatnonzero(begin[inside]), len(kept)).astype(np.int32)
    upto = np.searchsorted(first, bounds)
    number = np.diff(upto)
    place = np.arange(len(first)) - np.repeat(upto[:-1], number)
    return np.repeat(np.arange(len(texts)), number), place, pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
