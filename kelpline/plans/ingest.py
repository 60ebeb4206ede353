"""Request validation, tickets and search queries (operators A4, D*, E*, I*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import store
from ..functions import canonical, mapping
from ..operators import prefix, search, tickets, validation
from ..operators.flatten import combined_groups, nest_requests
from ..sources import otlp_json
from ..sources.driver_tables import log_rows, log_tables, raw_records, table
from .read_model import log, logs
from .registry import query

SHAPE = "shape AS (SELECT request_id, count(*) AS records, count(DISTINCT resource_idx * 2 + scope_idx) AS chunks FROM raw GROUP BY request_id)"
BODY = "octet_length(encode(raw_body))"


@log("a4_combined_groups", "SELECT request_id, resource_idx, count(*) AS records FROM raw GROUP BY request_id, resource_idx")
def a4(spark, sf):
    return combined_groups(nest_requests(raw_records(spark, sf)))


@log("d1_request_shape", f", {SHAPE} SELECT * FROM shape")
def d1(spark, sf):
    return validation.request_shape(raw_records(spark, sf))


def _reasons(spark, sf, reason, **limits):
    return validation.request_violations(raw_records(spark, sf), validation.Limits(**limits), [reason])


@log("d2_record_cap", f", {SHAPE} SELECT request_id, 'record_count' AS reason FROM shape WHERE records > 99")
def d2(spark, sf):
    return _reasons(spark, sf, "record_count", records=99)


@log("d7_body_bytes", f"SELECT DISTINCT request_id, 'body_bytes' AS reason FROM raw WHERE {BODY} > 19")
def d7(spark, sf):
    return _reasons(spark, sf, "body_bytes", body_bytes=19)


@log("d8_string_bytes", "SELECT DISTINCT request_id, 'string_bytes' AS reason FROM raw WHERE greatest(length(url), length(sev_text), length(raw_name)) > 27")
def d8(spark, sf):
    return _reasons(spark, sf, "string_bytes", string_bytes=27)


@log("d9_scope_expansion", "SELECT DISTINCT request_id, 'scope_expansion' AS reason FROM (SELECT request_id, resource_idx, scope_idx, 7 + CASE WHEN scope_idx = 0 THEN 3 ELSE 0 END + 3 + 56 + 1 + 32 AS meta, count(*) AS n FROM raw GROUP BY ALL) WHERE meta > 2000 // n")
def d9(spark, sf):
    return validation.scope_expansion(raw_records(spark, sf), validation.Limits(scope_bytes=2000)).distinct()


#: What some records of the wire requests carry, by id % 300: attributes of the record and of its scope, its body, the scope's schema URL.
DEEP = lambda n: '{"arrayValue":{"values":[' * n + '{"intValue":"1"}' + "]}}" * n
TEXT = lambda n: '{"stringValue":"' + "v" * n + '"}'
ENTRY = lambda k, v: '{"key":"' + k + '","value":' + v + "}"
KVLIST = lambda *entries: '{"kvlistValue":{"values":[' + ",".join(entries) + "]}}"
MANY = ",".join(ENTRY(f"a{i}", TEXT(1)) for i in range(21))
RECORD = {7: ENTRY("deep", DEEP(5)), 8: ENTRY("deep", DEEP(4)), 9: ENTRY("k" * 61, TEXT(1)), 11: ENTRY("list", KVLIST(ENTRY("k" * 61, TEXT(1)))), 12: ENTRY("long", TEXT(601)), 13: ENTRY("list", '{"arrayValue":{"values":[{"bytesValue":"' + "AAAA" * 201 + '"}]}}'), 16: MANY, 18: ENTRY("ref", '{"stringValueStrindex":3}'), 23: ENTRY("list", '{"arrayValue":{"values":[{"stringValueStrindex":3},{"doubleValue":10000000},{"doubleValue":1e-7},{"bytesValue":"3q0="},' + KVLIST(ENTRY("z", TEXT(1)), ENTRY("a", '{"boolValue":true}'), ENTRY("z", "{}")) + "]}}"), 24: ENTRY("esc", '{"stringValue":"a\\"b\\\\c\\n\\u0007"}')}
SCOPED = {10: ENTRY("s" * 61, TEXT(1)), 17: MANY, 25: ENTRY("ref", '{"stringValueStrindex":1}')}
BODIES = {14: KVLIST(ENTRY("b", TEXT(601))), 15: TEXT(2001), 20: '{"bytesValue":"/2E="}', 21: KVLIST(ENTRY("b", '{"intValue":"1"}'), ENTRY("a", '{"doubleValue":2.5}')), 22: '{"stringValueStrindex":2}'}
URLS = {19: "u" * 701}
WIRE_LIMITS = validation.Limits(records=1000, attributes=20, key_bytes=60, value_bytes=600, depth=4, body_bytes=2000, string_bytes=700, chunks=1000)
FAULTS = {7: "nesting_depth", 9: "key_bytes", 10: "key_bytes", 11: "key_bytes", 12: "value_bytes", 13: "value_bytes", 14: "value_bytes", 15: "body_bytes", 16: "attribute_count", 17: "attribute_count", 19: "string_bytes"}


def _nested(levels: int):
    """A value of lists inside each other, by built-in functions."""
    return F.concat(F.repeat(F.lit('{"arrayValue":{"values":['), levels), F.lit("{}"), F.repeat(F.lit("]}}"), levels))


def unreadable_lines(spark, sf):
    """events as lines of one request each, many of them broken in some way."""
    i = F.col("event_id")
    line = lambda value, rest="": F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"eventName":"'), i.cast("string"), F.lit('"' + rest + ',"attributes":[{"key":"v","value":'), value, F.lit("}]}]}]}]}"))
    good = line(F.concat(F.lit('{"intValue":"'), i.cast("string"), F.lit('"}')))
    kinds = [F.concat(F.lit("no json "), i.cast("string")), line(_nested(31)), line(_nested(33)), line(_nested(400)), F.concat(good, good), F.left(good, F.length(good) - 1), line(F.lit("{}"), ',"severityNumber":"x"'), line(F.lit('{"arrayValue":{"values":[{"intValue":"x"},{"boolValue":true}]}}')), F.lit("{}"), line(F.lit('{"doubleValue":"1.0f"}'))]
    value = good
    for k, text in enumerate(kinds):
        value = F.when(i % 12 == k, text).otherwise(value)
    return table(spark, sf, "events").select(i.cast("string").alias("request_id"), value.alias("value"))


@query("a1_unreadable_requests", "SELECT CAST(event_id AS VARCHAR) AS request_id, CASE WHEN event_id % 12 IN (2, 3) THEN 'nesting_depth' WHEN event_id % 12 IN (0, 4, 5, 6) THEN 'malformed' ELSE '' END AS reasons, CASE WHEN event_id % 12 IN (0, 2, 3, 4, 5, 6, 8) THEN 0 ELSE 1 END AS records FROM events")
def a1(spark, sf):
    """Each line's fate: rejected with its reasons, or the records that it gave."""
    parsed = otlp_json.parse_requests(unreadable_lines(spark, sf))
    records = otlp_json.flatten(parsed)
    violations = validation.request_violations(records, validation.Limits())
    rejected = validation.rejected_requests(parsed, violations)
    n = validation.judge_records(records, violations).where("accepted").groupBy("request_id").agg(F.count("*").cast("int").alias("records"))
    joined = parsed.select("request_id").join(rejected, "request_id", "left").join(n, "request_id", "left")
    return joined.select("request_id", F.coalesce(F.array_join("reasons", ","), F.lit("")).alias("reasons"), F.coalesce("records", F.lit(0)).alias("records"))


@query("a1_wrong_values", "SELECT 'invalid_scalar' AS reason, count(*) AS n FROM events WHERE event_id % 12 IN (7, 9)")
def a1_wrong(spark, sf):
    parsed = otlp_json.parse_requests(unreadable_lines(spark, sf))
    return validation.mapping_losses(otlp_json.flatten(parsed))


def wire_records(spark, sf):
    """events as export requests in JSON, one scope group for each record, read back as flat records (id is in the event name)."""
    e = table(spark, sf, "events")
    m = (F.col("event_id") % 300).cast("int")

    def pick(cells: dict[int, str], rest):
        out = rest
        for k, v in cells.items():
            out = F.when(m == k, F.lit(v)).otherwise(out)
        return out

    body = pick(BODIES, F.concat(F.lit('{"stringValue":"'), "event_type", F.lit('"}')))
    record = F.concat(F.lit('{"eventName":"'), F.col("event_id").cast("string"), F.lit('","timeUnixNano":"5","body":'), body, F.lit(',"attributes":['), pick(RECORD, F.lit("")), F.lit("]}"))
    scope = F.concat(F.lit('{"scope":{"name":"s","attributes":['), pick(SCOPED, F.lit("")), F.lit(']},"schemaUrl":"'), pick(URLS, F.lit("")), F.lit('","logRecords":['), record, F.lit("]}"))
    groups = e.groupBy(F.expr("event_id div 100").alias("request_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", scope.alias("s")))), lambda x: x["s"]), ",").alias("scopes"))
    lines = groups.select("request_id", F.concat(F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc"}}]},"scopeLogs":['), "scopes", F.lit("]}]}")).alias("value"))
    return otlp_json.flatten(otlp_json.parse_requests(lines)).withColumn("id", F.col("event_name").cast("bigint"))


_faults = lambda reasons: f"SELECT DISTINCT event_id // 100 AS request_id, reason FROM events JOIN (VALUES {', '.join(f'({k}, {chr(39)}{r}{chr(39)})' for k, r in FAULTS.items() if r in reasons)}) v(m, reason) ON event_id % 300 = m"


def _wire_faults(spark, sf, *reasons):
    return validation.request_violations(wire_records(spark, sf), WIRE_LIMITS, reasons)


@query("d3_attribute_cap", _faults(["attribute_count"]))
def d3(spark, sf):
    return _wire_faults(spark, sf, "attribute_count")


@query("d4_key_bytes", _faults(["key_bytes"]))
def d4(spark, sf):
    return _wire_faults(spark, sf, "key_bytes")


@query("d5_value_bytes", _faults(["value_bytes"]))
def d5(spark, sf):
    return _wire_faults(spark, sf, "value_bytes")


@query("d6_nesting_depth", _faults(["nesting_depth"]))
def d6(spark, sf):
    return _wire_faults(spark, sf, "nesting_depth")


@query("d_wire_violations", _faults(set(FAULTS.values())))
def d_wire(spark, sf):
    return validation.request_violations(wire_records(spark, sf), WIRE_LIMITS)


@query("c15_strindex_losses", "SELECT 'string_value_strindex' AS reason, count(*) AS n FROM events WHERE event_id % 300 IN (18, 23, 25)")
def c15(spark, sf):
    return validation.mapping_losses(wire_records(spark, sf))


#: The canonical JSON of these attributes.
CANONICAL = {
    7: '{"deep":[[[[[1]]]]]}', 8: '{"deep":[[[[1]]]]}', 9: '{"' + "k" * 61 + '":"v"}', 11: '{"list":{"' + "k" * 61 + '":"v"}}', 12: '{"long":"' + "v" * 601 + '"}', 13: '{"list":["' + "00" * 603 + '"]}', 18: '{"ref":null}',
    16: '{"a0":"v","a1":"v","a10":"v","a11":"v","a12":"v","a13":"v","a14":"v","a15":"v","a16":"v","a17":"v","a18":"v","a19":"v","a2":"v","a20":"v","a3":"v","a4":"v","a5":"v","a6":"v","a7":"v","a8":"v","a9":"v"}',
    23: '{"list":[null,10000000.0,1e-7,"dead",{"a":true,"z":null}]}', 24: r'{"esc":"a\"b\\c\n\u0007"}',
}


@query("c10_nested_json", "SELECT event_id AS id, CASE event_id % 300 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CANONICAL.items()) + " ELSE '{}' END AS attributes_json FROM events")
def c10(spark, sf):
    return wire_records(spark, sf).select("id", canonical.attributes_json(F.col("attributes")).alias("attributes_json"))


@query("c7_c8_bodies", "SELECT event_id AS id, CASE event_id % 300 WHEN 14 THEN '{\"b\":\"' || repeat('v', 601) || '\"}' WHEN 15 THEN repeat('v', 2001) WHEN 20 THEN chr(65533) || 'a' WHEN 21 THEN '{\"a\":2.5,\"b\":1}' WHEN 22 THEN NULL ELSE event_type END AS body FROM events")
def c7_c8(spark, sf):
    return wire_records(spark, sf).select("id", mapping.body_choice(F.col("body"), F.col("body_json")).alias("body"))


@log("d10_chunk_cap", f", {SHAPE} SELECT request_id, 'chunk_count' AS reason FROM shape WHERE chunks > 6")
def d10(spark, sf):
    return _reasons(spark, sf, "chunk_count", chunks=6)


@log("d11_whole_request_rejection", f"SELECT id, NOT bool_or({BODY} > 19) OVER (PARTITION BY request_id) AS accepted FROM raw")
def d11(spark, sf):
    raw = raw_records(spark, sf)
    return validation.judge_records(raw, validation.request_violations(raw, validation.Limits(body_bytes=19))).select("id", "accepted")


def ticketed(spark, sf):
    """log rows with a ticket; some lose their resource, as poison."""
    rows = log_rows(spark, sf).withColumn("ticket", F.expr("id div 20 + 1"))
    return rows.withColumn("resource_id", F.when((F.col("event_type") == "error") & (F.col("id") % 29 == 0), None).otherwise(F.col("resource_id")))


TICKETS = ", t AS (SELECT *, id // 20 + 1 AS ticket, event_type = 'error' AND id % 29 = 0 AS poison FROM rec)"


@log("d13_poison_reason", f"{TICKETS} SELECT id, 'missing resource' AS reason FROM t WHERE poison")
def d13(spark, sf):
    return ticketed(spark, sf).select("id", validation.poison_reason().alias("reason")).where("reason IS NOT NULL")


@log("d14_salvage", f"{TICKETS} SELECT ticket, count_if(NOT poison) AS kept, count_if(poison) AS dropped FROM t GROUP BY ticket")
def d14(spark, sf):
    return validation.salvage(ticketed(spark, sf))[2]


@log("d14_quarantine", f"{TICKETS} SELECT id, ticket, 'missing resource' AS reason, left(body, 200) AS body_preview FROM t WHERE poison")
def d14q(spark, sf):
    return validation.salvage(ticketed(spark, sf))[1].select("id", "ticket", "reason", "body_preview")


STATES = "s AS (SELECT DISTINCT user_id, user_id % 4 AS m, user_id % 3 AS st, user_id % 5 AS lr, user_id % 7 AS ru FROM events)"


@query("d16_state_checks", f"WITH {STATES} SELECT user_id, (m < 3 AND st < 2 AND lr - 1 >= 0 AND (st = 1) = (ru > 3) AND (m > 0 OR st = 0)) AS valid FROM s")
def d16(spark, sf):
    u = F.col("user_id")
    name = lambda c, names: F.element_at(F.array(*[F.lit(n) for n in names]), (c + 1).cast("int"))
    rows = table(spark, sf, "events").select("user_id").distinct().select("user_id", name(u % 4, ["off", "body", "full", "other"]).alias("mode"), name(u % 3, ["current", "rebuilding", "broken"]).alias("status"), (u % 5 - 1).alias("last_rowid"), F.when(u % 7 > 3, u % 7).alias("rebuild_until"))
    return rows.select("user_id", validation.index_state_valid())


def batched(spark, sf):
    rows = log_rows(spark, sf)
    return tickets.size_batches(rows.select(F.col("service_name").alias("origin_id"), F.col("id").alias("ordinal"), F.expr("id div 20 + 1").alias("ticket")), 100)


BATCHES = ", b AS (SELECT service_name AS origin_id, id AS ordinal, id // 20 + 1 AS ticket, (row_number() OVER (PARTITION BY service_name ORDER BY id) - 1) // 100 AS batch_no FROM rec)"


@log("e1_size_batches", f"{BATCHES} SELECT origin_id, ordinal, ticket, batch_no FROM b")
def e1(spark, sf):
    return batched(spark, sf)


E2 = """WITH RECURSIVE r AS (SELECT CAST(user_id % 4 AS VARCHAR) AS o, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS p FROM events),
w AS (SELECT o, p, t, coalesce((SELECT min(x.p) FROM r x WHERE x.o = r.o AND x.p > r.p AND x.p <= r.p + 100 AND (x.t >= r.t + 600000 OR x.p = r.p + 100)), p + 100) AS nxt FROM r),
s AS (SELECT o, p, nxt, 0 AS b FROM w WHERE p = 1 UNION ALL SELECT w.o, w.p, w.nxt, s.b + 1 FROM s JOIN w ON w.o = s.o AND w.p = s.nxt)
SELECT r.o AS origin_id, r.event_id AS ordinal, r.t AS arrival_ms, s.b AS batch_no FROM r JOIN s ON s.o = r.o AND r.p >= s.p AND r.p < s.nxt"""


@query("e2_age_batches", E2)
def e2(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 4).cast("string").alias("origin_id"), F.col("event_id").alias("ordinal"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("arrival_ms"))
    return tickets.age_batches(rows, 100, 10 * 60 * 1000)


@log("e3_segments", f"{BATCHES} SELECT origin_id, batch_no, b.ticket, count(*) AS records, max(ordinal) = any_value(last) AS complete FROM b JOIN (SELECT ticket, max(ordinal) AS last FROM b GROUP BY ticket) l ON l.ticket = b.ticket GROUP BY origin_id, batch_no, b.ticket")
def e3(spark, sf):
    return tickets.segments(batched(spark, sf))


def ticket_events(spark, sf):
    """Ticket events of the log rows: committed or dropped per row, complete for all tickets but the seventh."""
    rows = ticketed(spark, sf).select("ticket", F.when(F.col("resource_id").isNull(), "dropped").otherwise("committed").alias("kind"), F.lit(1).cast("bigint").alias("records"))
    done = rows.select("ticket").distinct().where("ticket <> 7").select("ticket", F.lit("complete").alias("kind"), F.lit(0).cast("bigint").alias("records"))
    return rows.unionByName(done)


STATE = f"{TICKETS}, st AS (SELECT ticket, CASE WHEN ticket = 7 THEN 'Unsettled' WHEN count_if(poison) > 0 THEN 'Failed' ELSE 'Completed' END AS state, count_if(NOT poison) AS committed, count_if(poison) AS dropped FROM t GROUP BY ticket)"


@log("e4_ticket_states", f"{STATE} SELECT * FROM st")
def e4(spark, sf):
    return tickets.ticket_states(ticket_events(spark, sf))


@log("e5_watermark", f"{STATE} SELECT coalesce(min(ticket) FILTER (WHERE state = 'Unsettled') - 1, max(ticket)) AS committed_through FROM st")
def e5(spark, sf):
    return tickets.watermark(tickets.ticket_states(ticket_events(spark, sf)))


@log("e6_outstanding", f"{STATE} SELECT count_if(state = 'Unsettled') AS outstanding FROM st")
def e6(spark, sf):
    return tickets.outstanding(tickets.ticket_states(ticket_events(spark, sf)))


def request_tickets(spark, sf):
    return ticketed(spark, sf).groupBy("request_id", "ticket").agg(F.count("*").alias("records"))


@log("e7_commit_acks", f"{STATE} SELECT request_id, total, committed, total - committed AS rejected, CASE WHEN total = committed THEN NULL WHEN dropped = total - committed THEN 'quarantined' ELSE 'not_committed' END AS reason, committed > 0 AS available FROM (SELECT request_id, count(*) AS total, count_if(NOT poison) AS committed, count_if(poison) AS dropped FROM t GROUP BY request_id)")
def e7(spark, sf):
    return tickets.commit_acks(request_tickets(spark, sf), tickets.ticket_states(ticket_events(spark, sf)))


@log("e8_enqueue_acks", "SELECT request_id, count(*) AS total, count_if(id % 100 >= 60) AS rejected, count_if(id % 100 < 60) > 0 AS available FROM raw GROUP BY request_id")
def e8(spark, sf):
    taken = raw_records(spark, sf).where("id % 100 < 60").groupBy("request_id").agg(F.count("*").alias("taken"))
    return tickets.enqueue_acks(request_tickets(spark, sf), taken)


@log("e9_batch_counters", f"{BATCHES} SELECT (SELECT count(*) FROM (SELECT DISTINCT origin_id, ticket FROM b)) AS chunks, count(*) AS batches, count_if(n = 100) AS full, count_if(n < 100) AS flushed, (SELECT count(*) FROM rec WHERE event_type = 'error' AND id % 29 = 0) AS dropped FROM (SELECT count(*) AS n FROM b GROUP BY origin_id, batch_no)")
def e9(spark, sf):
    return tickets.batch_counters(batched(spark, sf), 100, validation.salvage(ticketed(spark, sf))[1])


PROGRESS = "WITH s AS (SELECT epoch_us(ts) // 1000 AS t_ms, count_if(event_type = 'purchase') AS k FROM events GROUP BY 1), c AS (SELECT t_ms, sum(k) OVER (ORDER BY t_ms)::BIGINT AS n FROM s)"


def progress(spark, sf):
    """How many purchases had been seen at each time; between two of them the count stands still."""
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t_ms")
    return prefix.running(table(spark, sf, "events").groupBy(t).agg(F.count_if(F.col("event_type") == "purchase").alias("n")), (), "t_ms", {"n": "sum"})


@query("e11_drained_at", f"{PROGRESS} SELECT min(t_ms) AS t_ms FROM c WHERE n >= 100")
def e11(spark, sf):
    return tickets.drained_at(progress(spark, sf), 100)


@query("e11_drained_stable", f"{PROGRESS} SELECT min(t_ms) AS t_ms FROM (SELECT *, min(t_ms) OVER (PARTITION BY n) AS since FROM c) WHERE n > 0 AND t_ms - since >= 600000")
def e11_stable(spark, sf):
    return tickets.drained_at(progress(spark, sf), stable_ms=600_000)


DOCS = "d AS (SELECT doc_id AS id, text AS body, source AS service_name, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+') AS words FROM documents)"


def corpus(spark, sf):
    """All documents as searchable rows."""
    none = F.lit("")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("source").alias("service_name"), *[none.alias(c) for c in ("event_name", "severity_text", "attributes_json", "scope_name")])


@query("i1_tokens", f"WITH {DOCS} SELECT id, words AS tokens FROM d")
def i1(spark, sf):
    from ..functions.tokens import tokens

    return corpus(spark, sf).select("id", tokens(F.col("body")).alias("tokens"))


def body_index(spark, sf):
    """The stored postings of all documents, in blocks."""
    return store.derived(spark, "postings_body", f"{sf}/documents.parquet", lambda path: search.write_index(search.blocks(corpus(spark, sf), "body"), path))


def full_index(spark, sf):
    """The stored postings of all columns of the log rows, in blocks."""
    return store.derived(spark, "postings_full", f"{sf}/events.parquet", lambda path: search.write_index(search.blocks(logs(spark, sf), "full"), path))


@query("i2_postings_body", f"WITH {DOCS} SELECT w AS term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, unnest(words) AS w FROM d) GROUP BY w")
def i2(spark, sf):
    return search.term_counts(body_index(spark, sf), "body", corpus(spark, sf).select("id"))


@log("i3_postings_full", "SELECT col AS \"column\", w AS term, count(*) AS n FROM (SELECT 'body' AS col, unnest(regexp_extract_all(lower(coalesce(body, '')), '[a-z0-9]+')) AS w FROM logs UNION ALL SELECT 'service_name', unnest(regexp_extract_all(lower(service_name), '[a-z0-9]+')) FROM logs UNION ALL SELECT 'event_name', unnest(regexp_extract_all(lower(coalesce(event_name, '')), '[a-z0-9]+')) FROM logs UNION ALL SELECT 'severity_text', unnest(regexp_extract_all(lower(coalesce(severity_text, '')), '[a-z0-9]+')) FROM logs UNION ALL SELECT 'scope_name', unnest(regexp_extract_all(lower(scope_name), '[a-z0-9]+')) FROM logs UNION ALL SELECT 'attributes_json', unnest(regexp_extract_all(lower(attributes_json), '[a-z0-9]+')) FROM logs) GROUP BY col, w")
def i3(spark, sf):
    return full_index(spark, sf).groupBy("column", "term").agg(F.sum("n").alias("n"))


@query("i7_segments", f"WITH {DOCS} SELECT w AS term, count(*) AS n FROM (SELECT unnest(words) AS w FROM d WHERE id % 3 <> 0) GROUP BY w")
def i7(spark, sf):
    """The index grown by appends and a delete: segments, tombstones and a merge instead of a new index."""
    from ..operators.segments import SegmentedIndex

    index, rows = SegmentedIndex(spark, f"{store.shared_dir(spark)}/segments-{uuid.uuid4().hex}", "body"), corpus(spark, sf)
    for k in range(4):
        index.append(rows.where(F.pmod("id", F.lit(4)) == k))
        if k == 2:
            index.delete(rows.where("id % 3 = 0 AND pmod(id, 4) <= 2"))
    index.delete(rows.where("id % 3 = 0 AND pmod(id, 4) = 3"))
    return index.blocks().groupBy("term").agg(F.sum("n").alias("n"))


@query("i4_postings_off", "SELECT doc_id AS id, '' AS term FROM documents WHERE false")
def i4(spark, sf):
    return search.postings(corpus(spark, sf), "off").select("id", "term")


@query("i5_term_search", f"WITH {DOCS} SELECT id FROM d WHERE list_contains(words, 'worthless')")
def i5(spark, sf):
    rows = corpus(spark, sf)
    return search.term_search(body_index(spark, sf), rows, "worthless").select("id")


@query("i5_term_scan", f"WITH {DOCS} SELECT id FROM d WHERE list_contains(words, 'worthless')")
def i5s(spark, sf):
    return corpus(spark, sf).where(search.contains_term(F.col("body"), "worthless")).select("id")


@log("i6_column_search", "SELECT id FROM logs WHERE service_name = 'svc-1'")
def i6(spark, sf):
    rows = logs(spark, sf)
    hits = search.term_search(full_index(spark, sf), rows, "1", "service_name")
    return hits.select("id")


@query("i8_index_delete", f"WITH {DOCS} SELECT id, count(*) AS n FROM (SELECT id, unnest(words) AS w FROM d WHERE id % 3 <> 0) GROUP BY id")
def i8(spark, sf):
    rows = corpus(spark, sf)
    return search.without_deleted(search.unblocked(body_index(spark, sf)), rows.where("id % 3 = 0")).groupBy("id").agg(F.count("*").alias("n"))


@log("i9_rebuild_index", "SELECT w AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(body, '')), '[a-z0-9]+')) AS w FROM rec) GROUP BY w")
def i9(spark, sf):
    """A rebuild in pages of 2,000 rows, stopped after the first and taken up again."""
    events, _ = log_tables(spark, sf)
    top = events.agg(F.max("id")).first()[0]
    root = f"{store.shared_dir(spark)}/rebuild-{uuid.uuid4().hex}"
    again = lambda: search.Rebuild(spark, events, root, "body", top or 0)
    again().step()
    rest = again()
    while rest.step():
        pass
    return rest.index().groupBy("term").agg(F.count("*").alias("n"))


@log("i10_reconcile", "SELECT 1 AS id, 'full' AS mode, 'rebuilding' AS status, CAST(0 AS BIGINT) AS last_rowid, max(id) AS rebuild_until FROM rec")
def i10(spark, sf):
    events, _ = log_tables(spark, sf)
    top = events.agg(F.max("id").alias("top"))
    state = top.select(F.lit(1).alias("id"), F.lit("body").alias("mode"), F.lit("current").alias("status"), F.col("top").alias("last_rowid"), F.lit(None).cast("bigint").alias("rebuild_until"))
    return search.reconcile(state, "full", top.first()[0] or 0)


@log("i11_index_status", "SELECT 'body' AS mode, 'current' AS status, max(id) AS indexed_through, false AS rebuilding, true AS mode_mismatch FROM rec")
def i11(spark, sf):
    events, _ = log_tables(spark, sf)
    state = events.agg(F.max("id").alias("last_rowid")).select(F.lit("body").alias("mode"), F.lit("current").alias("status"), "last_rowid")
    return search.index_status(state, "full")


