"""Column functions that turn wire values into stored values. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 9223372036854775807
#: The severities that have a name of their own.
SEVERITY_NAMES = {1: "TRACE", 5: "DEBUG", 9: "INFO", 13: "WARN", 17: "ERROR", 21: "FATAL"}


def saturate_timestamp(raw: Column) -> Column:
    """An unsigned 64-bit time (DECIMAL(20,0)) as a long, cut off at the largest long."""
    return F.least(raw, F.lit(LONG_MAX).cast("decimal(20,0)")).cast("bigint")


def timestamp_overflows(raw: Column) -> Column:
    return F.coalesce(raw > F.lit(LONG_MAX).cast("decimal(20,0)"), F.lit(False))


def event_time(time: Column, observed: Column) -> Column:
    """The record's own time, or when it was observed if it has none (0)."""
    return F.when(time == 0, observed).otherwise(time)


def event_date(timestamp_ns: Column) -> Column:
    """The UTC day of a time in nanoseconds, for partitioning."""
    day = 86_400_000_000_000
    return F.date_add(F.lit("1970-01-01").cast("date"), ((timestamp_ns - F.pmod(timestamp_ns, F.lit(day))) / day).cast("int"))


def in_range(timestamp_ns: str, low: int, high: int, date: str | None = "event_date") -> Column:
    """low <= time < high, and the same of the day, which prunes partitions."""
    time = (F.col(timestamp_ns) >= low) & (F.col(timestamp_ns) < high)
    return time & F.col(date).between(event_date(F.lit(low)), event_date(F.lit(high - 1))) if date else time


def severity(number: Column) -> Column:
    """Severity numbers outside 0..24 are unspecified (0)."""
    return F.when(number.between(0, 24), number).otherwise(F.lit(0)).cast("int")


def severity_unknown(number: Column) -> Column:
    return ~F.coalesce(number.between(0, 24), F.lit(True))


def severity_name(number: Column) -> Column:
    """Only the first number of each range has a name; the others print as UNSPECIFIED."""
    out = F.lit("UNSPECIFIED")
    for k, name in SEVERITY_NAMES.items():
        out = F.when(number == k, F.lit(name)).otherwise(out)
    return out


def parse_id(raw: Column, length: int) -> Column:
    """A trace or span id: exactly ``length`` bytes that aren't all zero, else null."""
    zeros = F.unhex(F.lit("00" * length))
    return F.when((F.octet_length(raw) == length) & (raw != zeros), raw)


def id_invalid(raw: Column, length: int) -> Column:
    """Present (not null, not empty) but unusable."""
    return F.coalesce((F.octet_length(raw) > 0) & parse_id(raw, length).isNull(), F.lit(False))


def hex_text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def body_choice(text: Column, structured: Column) -> Column:
    """Non-empty text, else the structured body's JSON, else null."""
    return F.coalesce(non_empty(text), structured)


def lossy_text(raw: Column) -> Column:
    """Bytes as text; broken sequences become U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def _digits(value: Column) -> tuple[Column, Column, Column]:
    """Sign, significant digits, and where the point stands before them: the number is 0.digits * 10**point. Zero has no digits."""
    text = F.abs(value).cast("string")
    whole, part, power = (F.regexp_extract(text, r"^(\d+)\.(\d+)(?:E(-?\d+))?$", k) for k in (1, 2, 3))
    both = F.concat(whole, part)
    led = F.regexp_replace(both, "^0+", "")
    point = F.length(whole) + F.coalesce(F.nullif(power, F.lit("")).cast("int"), F.lit(0)) - (F.length(both) - F.length(led))
    # minus zero keeps its sign
    sign = F.when(value.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return sign, F.regexp_replace(led, "0+$", ""), point


def _placed(digits: Column, point: Column, whole_tail: str) -> Column:
    """Digits with the point in its place and zeros where they are needed; ``whole_tail`` ends whole numbers."""
    n = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(whole_tail))
    return F.when(n == 0, F.lit("0" + whole_tail)).when(point <= 0, small).when(point >= n, large).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))


def plain_double(value: Column) -> Column:
    """A double without exponent: 5.0 prints as 5, 1e-7 as 0.0000001; not-a-number and infinities as NaN, inf, -inf."""
    sign, digits, point = _digits(value)
    odd = F.when(F.isnan(value), F.lit("NaN")).when(value == float("inf"), F.lit("inf")).when(value == float("-inf"), F.lit("-inf"))
    return odd.when(value.isNotNull(), F.concat(sign, _placed(digits, point, "")))


def scalar_body(text: Column, integer: Column, double: Column, boolean: Column) -> Column:
    """The one scalar that is set, as text."""
    return F.coalesce(text, integer.cast("string"), plain_double(double), boolean.cast("string"))


def json_double(value: Column) -> Column:
    """A double in JSON: 5.0, 10000000.0, 0.00001, 1e-6, 1e21; an exponent from 1e16 on and below 1e-5. Not finite: null."""
    sign, digits, point = _digits(value)
    n = F.length(digits)
    power = F.concat(F.lit("e"), (point - 1).cast("string"))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit("")), power)
    plain = (n == 0) | ((point > -5) & (point <= 16))
    text = F.concat(sign, F.when(plain, _placed(digits, point, ".0")).otherwise(scientific))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit("null")).otherwise(text)


def safe_preview(text: Column, length: int = 200) -> Column:
    """The first characters on one line: control characters become U+FFFD."""
    return F.regexp_replace(F.left(text, F.lit(length)), r"\p{Cc}", "�")


def json_value(document: Column, key: str) -> Column:
    """A top-level value by key, where the key may have dots."""
    return F.get_json_object(document, f"$['{key}']")


def retention_cutoff(now_ns: int, window_ns: int) -> int:
    """now - window, not below the smallest long."""
    return max(now_ns - window_ns, -(2**63))


def series_key(name: Column, labels: Column) -> Column:
    """name{label=value,...} from a name and an array of (key, value) pairs."""
    return F.concat(name, F.lit("{"), F.array_join(F.transform(labels, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","), F.lit("}"))


def clamped_micros(seconds: Column) -> Column:
    """Seconds as whole microseconds within 0 and one hour."""
    return F.least(F.greatest(seconds * 1e6, F.lit(0.0)), F.lit(3.6e9)).cast("bigint")
