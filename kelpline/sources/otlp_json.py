"""Export requests as JSON text, one request per line or file, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import canonical, mapping
from ..schemas import REQUEST


#: Brackets that a request of legal depth has inside each other at most: the way to a value, four for each container, an entry in the last one.
LEGAL_BRACKETS = 10 + 4 * 32
#: Why a request can't be read.
MALFORMED, TOO_DEEP = "malformed", "nesting_depth"


def numbered(lines: DataFrame) -> DataFrame:
    """(request_id, value) of rows (file, value): the id comes from file and text, and from the line's place, as a line may be there twice."""
    return lines.select(F.concat_ws("-", _ident(), F.hex(F.monotonically_increasing_id())).alias("request_id"), "value")


def _ident() -> Column:
    return F.sha2(F.concat_ws("|", "file", "value"), 256)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(request_id, value, resourceLogs, reason) of JSON lines, one row for each line."""
    return parse_requests(numbered(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))))


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(file, value) as a stream over files that arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"))


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """As ``read_requests``, over such a stream. Rows of a stream have no numbers, so equal lines of one file share their request_id."""
    return parse_requests(stream_lines(spark, path, files_per_trigger).select(_ident().alias("request_id"), "value"))


def parse_requests(lines: DataFrame) -> DataFrame:
    """(request_id, value, resourceLogs, reason) of rows (request_id, value): one row for each of them.

    A line that can't be read has no resourceLogs, but a reason: malformed (no JSON object, more than
    one, or a field of the wrong kind), or nesting_depth. Brackets are counted in the bytes before a
    parser sees them, as parsers have bounds of their own. An object without resourceLogs is an empty
    request. Times and 64-bit integers may be strings or numbers: they are read as strings.
    """
    from ..functions.json_bytes import frame

    store.small_batches(lines.sparkSession)  # a line is a whole request
    framed = lines.select("request_id", "value", frame(F.col("value")).alias("f"))
    reason = F.when(F.col("f.framed") & (F.col("f.depth") <= LEGAL_BRACKETS), None).when(F.col("f.depth") > LEGAL_BRACKETS, TOO_DEEP).otherwise(MALFORMED)
    judged = framed.select("request_id", "value", reason.alias("reason"))
    parsed = judged.withColumn("r", F.from_json(F.when(F.col("reason").isNull(), F.col("value")), f"{REQUEST}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    reason = F.coalesce("reason", F.when(F.col("r._corrupt").isNotNull(), F.lit(MALFORMED)))
    return parsed.select("request_id", "value", F.when(reason.isNull(), F.col("r.resourceLogs")).alias("resourceLogs"), reason.alias("reason"))


def wire_value(value: Column) -> Column:
    """A typed value struct as the JSON text that the nested walk reads; containers stay as they are."""
    scalar = F.to_json(F.struct(*[value[c].alias(c) for c in ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "stringValueStrindex")]))
    return F.when(value["arrayValue"].isNotNull(), F.concat(F.lit('{"arrayValue":'), value["arrayValue"], F.lit("}"))).when(value["kvlistValue"].isNotNull(), F.concat(F.lit('{"kvlistValue":'), value["kvlistValue"], F.lit("}"))).otherwise(scalar)


def scalar_json(value: Column) -> Column:
    """JSON of a value that is no container, from built-in expressions. One that isn't of the kind that it claims is null."""
    number = mapping.json_double(canonical.double_number(value["doubleValue"]))
    raw = F.concat(F.lit('"'), F.lower(F.hex(canonical.wire_bytes(value["bytesValue"]))), F.lit('"'))
    return F.coalesce(F.when(value["stringValue"].isNotNull(), canonical.json_string(value["stringValue"])), canonical.whole_number(value["intValue"]).cast("string"), number, canonical.truth(value["boolValue"]).cast("string"), raw, F.lit("null"))


def scalar_losses(value: Column) -> Column:
    """1 if a value that is no container isn't of the kind that it claims, else 0."""
    kinds = {"intValue": canonical.whole_number, "doubleValue": canonical.double_number, "boolValue": canonical.truth, "bytesValue": canonical.wire_bytes}
    wrong = F.lit(False)
    for name, read in kinds.items():
        wrong = wrong | (value[name].isNotNull() & read(value[name]).isNull())
    return F.when(value["stringValue"].isNull() & wrong, 1).otherwise(0)


def flatten(requests: DataFrame) -> DataFrame:
    """One row per log record with positions; groups without records vanish. Scope columns are rendered at scope grain.

    Attribute lists come as key and JSON text; beside each stands what the walk over its values tells
    (``*_facts``), and how many they are (``*_n``), which needs no walk. Lists and bodies without containers are rendered by built-in expressions, the others
    by an Arrow function, at the grain of their group.
    """
    store.small_batches(requests.sparkSession)
    groups = requests.select("request_id", F.posexplode("resourceLogs").alias("resource_idx", "g"))
    groups = groups.select("request_id", "resource_idx", F.coalesce("g.schemaUrl", F.lit("")).alias("schema_url"), _facts(F.col("g.resource.attributes")).alias("resource_facts"), F.col("g.resource.attributes").alias("resource_kv"), F.col("g.scopeLogs").alias("scopes"))
    scopes = groups.select("*", F.posexplode("scopes").alias("scope_idx", "s")).drop("scopes")
    scopes = scopes.select("request_id", "resource_idx", "scope_idx", "schema_url", "resource_kv", "resource_facts", F.coalesce("s.scope.name", F.lit("")).alias("scope_name"), F.coalesce("s.scope.version", F.lit("")).alias("scope_version"), F.coalesce("s.schemaUrl", F.lit("")).alias("scope_schema_url"), F.col("s.scope.attributes").alias("scope_kv"), _facts(F.col("s.scope.attributes")).alias("scope_facts"), "s.logRecords")
    rows = scopes.select("*", F.posexplode("logRecords").alias("record_idx", "r")).drop("logRecords")
    rows = rows.withColumns({"attribute_facts": _facts(F.col("r.attributes")), "body_fact": canonical.walk_json(F.when(_container(F.col("r.body")), wire_value(F.col("r.body"))))})
    times = [F.col("r.timeUnixNano"), F.col("r.observedTimeUnixNano")]
    body = F.col("r.body")
    wrong = F.when(_container(body), 0).otherwise(scalar_losses(body)) + sum((F.when(t.isNotNull() & _unsigned(t).isNull(), 1).otherwise(0) for t in times), F.lit(0))
    has = F.col("body_fact.json").isNotNull() & _container(body)
    raw = canonical.wire_bytes(body["bytesValue"])
    # text that is no hex is there, but no id
    ident = lambda c: F.coalesce(F.when(F.col(c).rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(c)), F.when(F.col(c).isNotNull(), F.unhex(F.lit("00"))))
    zero = F.lit(0).cast("decimal(20,0)")
    return rows.select(
        "request_id", "resource_idx", "scope_idx", "record_idx", "schema_url", _pairs(F.col("resource_kv"), F.col("resource_facts")).alias("resource_attributes"), "resource_facts", "scope_name", "scope_version", "scope_schema_url", _pairs(F.col("scope_kv"), F.col("scope_facts")).alias("scope_attributes"), "scope_facts",
        F.coalesce(_unsigned(times[0]), zero).alias("time_unix_nano"), F.coalesce(_unsigned(times[1]), zero).alias("observed_time_unix_nano"), F.coalesce("r.severityNumber", F.lit(0)).alias("severity_number"), F.coalesce("r.severityText", F.lit("")).alias("severity_text"),
        F.coalesce(mapping.scalar_body(body["stringValue"], canonical.whole_number(body["intValue"]), canonical.double_number(body["doubleValue"]), canonical.truth(body["boolValue"])), mapping.lossy_text(raw), F.lit("")).alias("body"),
        F.when(has, F.col("body_fact.json")).alias("body_json"), F.when(has, F.col("body_fact")).alias("body_fact"), wrong.alias("wrong_scalars"), F.coalesce(F.octet_length(body["stringValue"]), F.octet_length(raw), F.lit(0)).alias("body_size"),
        ident("r.traceId").alias("trace_id"), ident("r.spanId").alias("span_id"), F.coalesce("r.eventName", F.lit("")).alias("event_name"), F.coalesce("r.flags", F.lit(0)).cast("bigint").alias("flags"), F.coalesce("r.droppedAttributesCount", F.lit(0)).cast("bigint").alias("dropped_attributes_count"),
        _pairs(F.col("r.attributes"), F.col("attribute_facts")).alias("attributes"), "attribute_facts",
        *[F.when(F.col(kv).isNull(), 0).otherwise(F.size(kv)).alias(f"{name}_n") for name, kv in (("attributes", "r.attributes"), ("resource_attributes", "resource_kv"), ("scope_attributes", "scope_kv"))],
    )


def _unsigned(text: Column) -> Column:
    """An unsigned 64-bit number as DECIMAL(20,0), or null."""
    number = F.when(text.rlike("^[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)


def _container(value: Column) -> Column:
    return F.coalesce(value["arrayValue"].isNotNull() | value["kvlistValue"].isNotNull(), F.lit(False))


def _facts(kv: Column) -> Column:
    """What the walk over each value tells: one struct for each attribute."""
    kv = F.coalesce(kv, F.array())
    zero = F.lit(0)

    def plain(x: Column) -> Column:
        v = x["value"]
        leaf = F.coalesce(F.octet_length(v["stringValue"]), F.octet_length(canonical.wire_bytes(v["bytesValue"])), zero)
        return F.struct(scalar_json(v).alias("json"), zero.alias("depth"), zero.alias("max_key_bytes"), leaf.alias("max_leaf_bytes"), (leaf + canonical.NODE_OVERHEAD).cast("bigint").alias("size"), F.when(v["stringValueStrindex"].isNotNull(), 1).otherwise(0).alias("strindex_losses"), scalar_losses(v).alias("scalar_losses"))

    deep = canonical.walk_all(F.when(F.exists(kv, lambda x: _container(x["value"])), F.transform(kv, lambda x: F.coalesce(wire_value(x["value"]), F.lit("{}")))))
    return F.coalesce(deep, F.transform(kv, plain))


def _pairs(kv: Column, facts: Column) -> Column:
    """Key and JSON text of each attribute."""
    return F.coalesce(F.zip_with(kv, facts, lambda x, f: F.struct(x["key"].alias("key"), f["json"].alias("value"))), F.array().cast(canonical.ATTRIBUTES))
