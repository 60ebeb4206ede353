"""Combined Log Format lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: remote, identity, user, time, method, path, protocol, status, bytes, referer, agent
LINE = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "(\S+) (\S+) ([^"]*)" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?'
FIELDS = ["remote", "identity", "user", "stamp", "method", "path", "protocol", "status", "bytes", "referer", "agent"]


def parse_access_log(lines: DataFrame) -> DataFrame:
    """The other columns, the fields, and time; a line that doesn't match has null fields."""
    fits = F.col("value").rlike(LINE)
    parts = {n: F.when(fits, F.nullif(F.regexp_extract("value", LINE, i + 1), F.lit("-"))) for i, n in enumerate(FIELDS)}
    out = lines.withColumns(parts)
    typed = {"status": F.col("status").try_cast("bigint"), "bytes": F.col("bytes").try_cast("bigint"), "time": F.try_to_timestamp("stamp", F.lit("dd/MMM/yyyy:HH:mm:ss Z"))}
    return out.withColumns(typed).drop("value", "stamp")
