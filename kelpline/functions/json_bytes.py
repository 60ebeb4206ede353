"""What the bytes of JSON lines tell before any parser sees them: how deep their brackets go, and whether they frame one object."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that are scanned together; a longer line is scanned by itself.
SLICE = 1 << 20
FRAME = "struct<depth:int,framed:boolean>"


def _scan(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """depth and framed of each line [starts[i], starts[i + 1]) of the bytes. Brackets inside strings don't count."""
    n = len(starts) - 1
    first = starts[:-1]
    # quotes that a backslash doesn't escape; a run of backslashes escapes by its last one if it is odd
    quotes = np.flatnonzero(data == 34)
    back = data == 92
    if back.any():
        place = np.arange(len(data))
        last = np.maximum.accumulate(np.where(back, -1, place))  # the last other byte up to each one
        before = np.maximum(quotes - 1, 0)
        line = first[np.searchsorted(first, quotes, "right") - 1]
        run = np.where(quotes > line, before - np.maximum(last[before], line - 1), 0)
        quotes = quotes[run % 2 == 0]
    brackets = np.flatnonzero((data == 123) | (data == 125) | (data == 91) | (data == 93))
    passed = np.searchsorted(quotes, starts)
    owner = np.searchsorted(first, brackets, "right") - 1
    outside = (np.searchsorted(quotes, brackets) - passed[owner]) % 2 == 0
    brackets, owner = brackets[outside], owner[outside]
    step = np.where((data[brackets] == 123) | (data[brackets] == 91), 1, -1)
    total = np.concatenate([[0], np.cumsum(step)])
    at = np.searchsorted(brackets, starts)
    level = total[1:] - total[at[owner]]
    depth, lowest, zeros = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    some = at[1:] > at[:-1]
    if some.any():
        depth[some] = np.maximum.reduceat(level, at[:-1][some])
        lowest[some] = np.minimum.reduceat(level, at[:-1][some])
        zeros[some] = np.add.reduceat((level == 0).astype(np.int64), at[:-1][some])
    # one object: all that isn't white space lies from its first bracket to its last
    ink = np.flatnonzero(~((data == 32) | ((data >= 9) & (data <= 13))))
    a, b = np.searchsorted(ink, starts[:-1]), np.searchsorted(ink, starts[1:])
    framed = some & (b > a) & (lowest == 0) & (zeros == 1) & ((passed[1:] - passed[:-1]) % 2 == 0)
    own = np.flatnonzero(framed)
    framed[own] = (ink[a[own]] == brackets[at[:-1][own]]) & (ink[b[own] - 1] == brackets[at[1:][own] - 1]) & (data[ink[a[own]]] == 123)
    return depth, framed


def scan_lines(lines: pa.Array) -> pa.StructArray:
    """depth and framed of each line; a null line has depth 0 and no frame."""
    text = lines.cast(pa.large_binary())
    text = text.fill_null(b"") if text.null_count else text
    _, raw, body = text.buffers()
    offsets = np.frombuffer(raw, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    depth, framed, a = [np.zeros(0, np.int64)], [np.zeros(0, bool)], 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        d, f = _scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        depth.append(d)
        framed.append(f)
        a = b
    return pa.StructArray.from_arrays([pa.array(np.concatenate(depth), pa.int32()), pa.array(np.concatenate(framed))], names=["depth", "framed"])


def frame(lines: Column) -> Column:
    """struct(depth, framed) of a column of JSON text."""

    @F.arrow_udf(FRAME)
    def scan(part: pa.Array) -> pa.Array:
        return scan_lines(part)

    return scan(lines)
