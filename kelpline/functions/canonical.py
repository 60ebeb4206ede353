"""Canonical JSON of attribute lists and nested values, and the identity of a resource."""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_bytes import scan_lines

#: array<struct<key string, value string>> where value is already JSON text.
ATTRIBUTES = "array<struct<key:string,value:string>>"


#: Characters that a JSON string escapes.
ESCAPED = r'["\\\x00-\x1f\x7f]'


def json_string(text: Column) -> Column:
    """A JSON string literal. The escapes are those of a minimal JSON writer: \\b \\f \\n \\r \\t, \\u00xx, quote and backslash."""
    escaped = F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")
    return F.when(text.rlike(ESCAPED), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def _last_of_each(attributes: Column, read: Callable[[Column], Column]) -> Column:
    """read(element) in order of the keys' bytes; null for all but the last of equal keys. One sort by key and place, then neighbours are compared."""
    placed = F.sort_array(F.transform(attributes, lambda x, i: F.struct(x["key"].alias("key"), (-i).alias("i"), x["value"].alias("value"))))
    # a null key stands for itself; sorted neighbours of one key begin with the last of the list
    again = lambda s, x, i: F.coalesce(x["key"] == F.get(s, i - 1)["key"], F.lit(False))
    # the sorted list is bound to a name, as an expression that stands twice is worked out twice
    return F.get(F.transform(F.array(placed), lambda s: F.transform(s, lambda x, i: F.when(~again(s, x, i), read(x)))), F.lit(0))


def last_wins(attributes: Column) -> Column:
    """In order of the keys' bytes; of equal keys only the last element stays."""
    return F.filter(_last_of_each(attributes, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))), lambda x: x.isNotNull())


def attributes_json(attributes: Column) -> Column:
    """{"key":value,...} in order of the keys' bytes; a repeated key keeps its last value."""
    # the elements that went are null, which array_join passes over
    entries = lambda key: F.array_join(_last_of_each(attributes, lambda x: F.concat(key(x["key"]), F.lit(":"), F.coalesce(x["value"], F.lit("null")))), ",")
    # keys seldom need escapes: one test over all of them spares one for each
    special = F.array_join(attributes["key"], "").rlike(ESCAPED)
    text = F.when(special, entries(json_string)).otherwise(entries(lambda key: F.concat(F.lit('"'), key, F.lit('"'))))
    return F.concat(F.lit("{"), text, F.lit("}"))


def attribute(attributes: Column, key: str) -> Column:
    """The last element with that key, or null."""
    return F.try_element_at(F.filter(attributes, lambda x: x["key"] == key), F.lit(-1))


def length_prefix(part: Column) -> Column:
    """The number of a string's bytes as eight bytes, least first."""
    big = F.lpad(F.hex(F.octet_length(part).cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(big, k, 2) for k in range(15, 0, -2)]))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 (hex) over the parts' UTF-8 bytes, each led by its length. Nulls count as empty."""
    pieces: list[Column] = []
    for p in parts:
        text = F.coalesce(p, F.lit(""))
        pieces += [length_prefix(text), F.encode(text, "UTF-8")]
    return F.sha2(F.concat(*pieces), 256)


#: What one walk over a value tells. scalar_losses counts values that aren't of the kind that they claim.
WALKED = "json string, depth int, max_key_bytes int, max_leaf_bytes int, size long, strindex_losses int, scalar_losses int"
#: Estimated bytes of a value's node, and of an entry of a list of keys and values.
NODE_OVERHEAD, ENTRY_OVERHEAD = 32, 56
#: A text with more brackets than this inside each other isn't parsed; each container takes four of them at most.
DEEPEST = 600
#: Fixed patterns: whole and other numbers as the wire writes them.
WHOLE, NUMBER = r"^-?[0-9]{1,19}$", r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
NOT_FINITE = ("NaN", "Infinity", "-Infinity")


def whole_number(text: Column) -> Column:
    """A signed 64-bit number as a long, or null."""
    return F.when(text.rlike(WHOLE), text.try_cast("bigint"))


def double_number(text: Column) -> Column:
    """A double, or null; NaN and infinities by their names."""
    return F.when(text.rlike(NUMBER) | text.isin(*NOT_FINITE), text.try_cast("double"))


def wire_bytes(text: Column) -> Column:
    """The bytes of base-64 text, of either alphabet, padded or not; null if it is none."""
    plain = F.rtrim(F.translate(text, "-_", "+/"), F.lit("="))
    whole = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.when(text == "", F.unhex(F.lit(""))).when(plain.rlike("^[A-Za-z0-9+/]*$") & (F.length(plain) % 4 != 1), F.try_to_binary(whole, F.lit("base64")))


def truth(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


def _literal(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def float_json(x: float) -> str:
    """As ``mapping.json_double``."""
    if not math.isfinite(x):
        return "null"
    sign, digits, power = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + power
    lead = "-" if sign else ""
    if not text:
        return lead + "0.0"
    if not -5 < point <= 16:
        return f"{lead}{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{point - 1}"
    if point <= 0:
        return f"{lead}0.{'0' * -point}{text}"
    return f"{lead}{text.ljust(point, '0')}.0" if point >= len(text) else f"{lead}{text[:point]}.{text[point:]}"


Walked = tuple[str, int, int, int, int, int, int]
_NULL: Walked = ("null", 0, 0, 0, NODE_OVERHEAD, 0, 0)
_WRONG: Walked = ("null", 0, 0, 0, NODE_OVERHEAD, 0, 1)


def _text(v: Any) -> str:
    """Where a string is wanted, other JSON stands for its own text."""
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


class _Container:
    """A list, or a list of keys and values, that is being walked."""

    def __init__(self, keys: list[str] | None, values: list):
        self.keys, self.values, self.done = keys, values, []

    def close(self) -> Walked:
        done = self.done
        if self.keys is None:
            body, keys, entries = "[" + ",".join(w[0] for w in done) + "]", [], 0
        else:
            last = {k: w[0] for k, w in zip(self.keys, done, strict=True)}
            body = "{" + ",".join(f"{_literal(k)}:{last[k]}" for k in sorted(last, key=str.encode)) + "}"
            keys, entries = [len(k.encode()) for k in self.keys], ENTRY_OVERHEAD * len(done)
        most = lambda k: max((w[k] for w in done), default=0)
        every = lambda k: sum(w[k] for w in done)
        return body, 1 + most(1), max([*keys, most(2)], default=0), most(3), NODE_OVERHEAD + sum(keys) + entries + every(4), every(5), every(6)


def _begin(value: Any) -> Walked | _Container:
    """A plain value's result, or the container that it opens."""
    if value is None:
        return _NULL
    if not isinstance(value, dict):
        return _WRONG
    kind, v = next(((k, v) for k, v in value.items() if v is not None), ("", None))
    if kind == "stringValueStrindex":
        return ("null", 0, 0, 0, NODE_OVERHEAD, 1, 0)
    if kind == "stringValue":
        text = _text(v)
        n = len(text.encode())
        return (_literal(text), 0, 0, n, NODE_OVERHEAD + n, 0, 0)
    if kind == "bytesValue":
        plain = _text(v).translate({45: "+", 95: "/"}).rstrip("=")
        if not re.fullmatch("[A-Za-z0-9+/]*", plain) or len(plain) % 4 == 1:
            return _WRONG
        raw = base64.b64decode(plain + "=" * (-len(plain) % 4))
        return (f'"{raw.hex()}"', 0, 0, len(raw), NODE_OVERHEAD + len(raw), 0, 0)
    if kind == "boolValue":
        text = _text(v)
        return (text, 0, 0, 0, NODE_OVERHEAD, 0, 0) if text in ("true", "false") else _WRONG
    if kind == "intValue":
        text = _text(v)
        return (str(int(text)), 0, 0, 0, NODE_OVERHEAD, 0, 0) if re.match(WHOLE, text) and -(2**63) <= int(text) < 2**63 else _WRONG
    if kind == "doubleValue":
        text = _text(v)
        return (float_json(float(text)), 0, 0, 0, NODE_OVERHEAD, 0, 0) if text in NOT_FINITE or re.match(NUMBER, text) else _WRONG
    if kind in ("arrayValue", "kvlistValue"):
        values = (v.get("values") if isinstance(v, dict) else v) or []
        if not isinstance(v, dict) or not isinstance(values, list):
            return _WRONG
        if kind == "arrayValue":
            return _Container(None, values)
        entries = [x if isinstance(x, dict) else {"value": x if x is None else 0} for x in values]
        return _Container([_text(x["key"]) if x.get("key") is not None else "" for x in entries], [x.get("value") for x in entries])
    return _NULL


def walk_value(value: Any) -> Walked:
    """Canonical JSON of a wire value ({"stringValue": ...} and so on), its depth, largest key and leaf, size and losses.

    Depth counts containers inside each other: a list of plain values has 1. A value that isn't of the
    kind that it claims becomes null and counts as a loss. Open containers stand on a stack.
    """
    now = _begin(value)
    open_: list[_Container] = []
    while True:
        if isinstance(now, _Container):
            open_.append(now)
        elif open_:
            open_[-1].done.append(now)
        else:
            return now
        top = open_[-1]
        now = _begin(top.values[len(top.done)]) if len(top.done) < len(top.values) else open_.pop().close()


def _walk_text(text: str | None) -> Walked:
    """walk_value of JSON text. Numbers stay text. What is deeper than any bound on depth is not parsed: its depth is told by its brackets."""
    if text is None:
        return _NULL
    if text.count("{") + text.count("[") > DEEPEST:
        depth = scan_lines(pa.array([text]))[0]["depth"].as_py()
        if depth > DEEPEST:
            return ("null", depth // 4, 0, 0, len(text), 0, 0)
    return walk_value(json.loads(text, parse_int=str, parse_float=str, parse_constant=str))


_FIELDS = [x.split(" ") for x in WALKED.split(", ")]
WALK_TYPE = T.StructType([T.StructField(n, {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}[t]) for n, t in _FIELDS])
WALK_DDL = ",".join(f"{n}:{'bigint' if t == 'long' else t}" for n, t in _FIELDS)
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def _struct(walks: list[Walked]) -> pa.StructArray:
    columns = list(zip(*walks, strict=True)) or [()] * len(_FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


@F.arrow_udf(WALK_TYPE)
def walk_json(values: pa.Array) -> pa.Array:
    """walk_value over JSON text; null text gives a null value."""
    return _struct([_walk_text(x) for x in values.to_pylist()])


@F.arrow_udf(T.ArrayType(WALK_TYPE))
def walk_all(lists: pa.Array) -> pa.Array:
    """walk_value over lists of JSON texts; a null list stays null."""
    inner = _struct([_walk_text(x) for x in lists.flatten().to_pylist()])
    sizes = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, inner, mask=lists.is_null())
