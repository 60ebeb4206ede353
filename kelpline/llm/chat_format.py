"""Chat transcripts from records of many layouts, by fingerprints of their nested field paths.

A record is JSON text or a variant. Its nested field paths ("messages[].role") that any layout knows are sorted and
hashed; the hash selects a declarative ``Layout``, which says where roles and texts stand. The turns of
all records of a conversation are put in order and written by a ``Template``, whose markers can't occur
inside texts: a backslash there is doubled, and a marker becomes a backslash and the marker's number.
Beside each transcript stand the spans (code points) that a loss counts. ``read_transcripts`` takes
turns, and the text under the loss mask, back out of what was written. All of it is column expressions.

Defined results: null texts and roles are empty ones. Turns with equal places are ordered by role, then
text; repeated rows are repeated turns. A null conversation id is a conversation of its own. A record of
no known layout, or that is no JSON object, keeps its row in ``canonical_turns`` with a null layout and
no turns. Fields that no layout knows change nothing. An empty table gives an empty result. A
conversation is one row of the result, so it has to fit into one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch


@dataclass(frozen=True)
class Say:
    """One turn: a fixed role, and the texts of the fields that aren't empty, joined by an empty line."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of an array: the names of its role and text fields, and roles that have other names here."""

    array: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Row:
    """The record is one turn, whose place among the others it tells."""

    place: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """A layout: the paths that a record must have, those that it may have, and where its turns come from."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Say | Each | Row, ...]

    def path_sets(self) -> list[frozenset[str]]:
        return [frozenset(self.required) | frozenset(more) for k in range(len(self.optional) + 1) for more in combinations(self.optional, k)]


_SHARED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Layout("turn_row", ("turn", "role"), ("text",), (Row("turn", "role", "text"),)),
    Layout("turn_row", ("turn", "text"), (), (Row("turn", "role", "text"),)),
    Layout("messages", ("messages", "messages[].role"), ("messages[].content",), (Each("messages", "role", "content"),)),
    Layout("message_parts", ("messages", "messages[].role", "messages[].content", "messages[].content[].text"), (), (Each("messages", "role", "content"),)),
    Layout("shared", ("conversations", "conversations[].from"), ("conversations[].value", "system"), (Say("system", ("system",)), Each("conversations", "from", "value", _SHARED))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (Say("system", ("system",)), Say("user", ("instruction", "input")), Say("assistant", ("output",)))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("response",)))),
    Layout("question_answer", ("question", "answer"), ("context",), (Say("user", ("context", "question")), Say("assistant", ("answer",)))),
    Layout("chosen", ("prompt", "chosen"), ("rejected",), (Say("user", ("prompt",)), Say("assistant", ("chosen",)))),
)


#: The pieces of a value's schema text that say where fields and elements begin and end.
_PIECES = r"(?:`(?:[^`]|``)+`|\w+): |OBJECT<|ARRAY<|>"
_STATE = "struct<stack:array<string>,at:string,found:array<string>>"


def _paths(value: Column, vocabulary: list[str]) -> Column:
    """The paths of the vocabulary that a value has, as a sorted array. Elements of an array share one path.

    Spark tells a value's schema as text; a fold over its pieces keeps a stack of the paths that are open.
    """
    known = F.array(*[F.lit(p) for p in vocabulary])
    state = lambda stack, at, found: F.struct(stack.alias("stack"), at.alias("at"), found.alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        stack, at, found = acc["stack"], acc["at"], acc["found"]
        inside = F.concat(at, F.lit("[]"))
        open_ = F.try_element_at(stack, F.lit(-1))
        path = F.concat(open_, F.when(open_ == "", "").otherwise("."), F.regexp_replace(piece, r"^`|`?: $", ""))
        return (
            F.when(piece == ">", state(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))), at, found))
            .when(piece == "OBJECT<", state(F.concat(stack, F.array(at)), at, found))
            .when(piece == "ARRAY<", state(F.concat(stack, F.array(inside)), inside, found))
            .otherwise(state(stack, path, F.when(F.array_contains(known, path), F.concat(found, F.array(path))).otherwise(found)))
        )

    none = F.array().cast("array<string>")
    pieces = F.regexp_extract_all(F.schema_of_variant(value), F.lit(_PIECES), 0)
    return F.array_sort(F.array_distinct(F.coalesce(F.aggregate(pieces, state(none, F.lit(""), none).cast(_STATE), step)["found"], none)))


def _key(paths: frozenset[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def _text(value: Column) -> Column:
    """A text field: a string, or parts whose texts belong together."""
    parts = F.try_variant_get(value, "$", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))), "")
    return F.coalesce(joined, F.try_variant_get(value, "$", "string"), F.lit(""))


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _turn(at: Column, role: Column, text: Column) -> Column:
    return F.struct(at.cast("bigint").alias("at"), F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))


_TURNS = "array<struct<at:bigint,role:string,text:string>>"


def _said(source: Say, value: Column, first: int, optional: bool) -> Column:
    texts = F.filter(F.array(*[_text(_field(value, f)) for f in source.fields]), lambda x: x != "")
    one = F.array(_turn(F.lit(first), F.lit(source.role), F.array_join(texts, "\n\n")))
    return F.when(F.size(texts) > 0, one).otherwise(F.array().cast(_TURNS)) if optional else one


def _each(source: Each, value: Column, first: int) -> Column:
    def turn(x: Column, i: Column) -> Column:
        role = F.try_variant_get(x, f"$.{source.role}", "string")
        named = F.try_element_at(F.create_map(*[F.lit(y) for pair in source.roles for y in pair]), role) if source.roles else role
        return _turn(first + i, F.coalesce(named, role), _text(_field(x, source.text)))

    return F.coalesce(F.transform(F.try_variant_get(value, f"$.{source.array}", "array<variant>"), turn), F.array().cast(_TURNS))


def _turns(layout: Layout, value: Column) -> Column:
    """The turns of a record in this layout. Turns of several sources are numbered in order; optional ones without text are left out."""
    parts = []
    for k, source in enumerate(layout.turns):
        if isinstance(source, Row):
            return F.array(_turn(F.try_variant_get(value, f"$.{source.place}", "bigint"), F.try_variant_get(value, f"$.{source.role}", "string"), _text(_field(value, source.text))))
        first = k << 32
        parts.append(_said(source, value, first, all(f in layout.optional for f in source.fields)) if isinstance(source, Say) else _each(source, value, first))
    return F.concat(*parts)


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records (JSON text or variants), with fingerprint, layout, and turns (at, role, text) in place of the record."""
    value = F.col("__v")
    vocabulary = sorted({p for x in layouts for s in x.path_sets() for p in s})
    given = F.col(f"`{record}`")
    read = records.withColumn("__v", given if records.schema[record].dataType.typeName() == "variant" else F.try_parse_json(given)).drop(record)
    read = read.withColumn("fingerprint", F.xxhash64(F.array_join(_paths(value, vocabulary), "\n")))
    known: dict[frozenset[str], int] = {}
    for k, x in enumerate(layouts):
        for s in x.path_sets():
            if known.setdefault(s, k) != k:
                raise ValueError(f"{x.name} and {layouts[known[s]].name} have the fingerprint of {sorted(s)}")
    read = read.withColumn("__k", F.try_element_at(F.create_map(*[c for s, k in known.items() for c in (_key(s), F.lit(k))]), F.col("fingerprint")))
    name = F.try_element_at(F.array(*[F.lit(x.name) for x in layouts]), F.col("__k") + 1)
    turns = F.array().cast(_TURNS)
    for k in range(len(layouts) - 1, -1, -1):
        turns = F.when(F.col("__k") == k, _turns(layouts[k], value)).otherwise(turns)
    return read.select(*[F.col(f"`{c}`") for c in records.columns if c != record], "fingerprint", name.alias("layout"), turns.alias("turns"))


@dataclass(frozen=True)
class Template:
    """open role middle text close, one turn after another. The loss counts the texts of ``learn``."""

    open: str = "<turn>"
    middle: str = "<text>"
    close: str = "</turn>\n"
    learn: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for m in self.markers:
            if not m or "\\" in m or m[0].isdigit() or any(m[0] in x[1:] for x in self.markers):
                raise ValueError(f"{m!r} could begin inside of a marker or an escape")

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.open, self.middle, self.close

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for k, m in enumerate(self.markers):
            out = F.replace(out, F.lit(m), F.lit(f"\\{k}"))
        return out

    def unescape(self, text: Column) -> Column:
        """Between doubled backslashes, each backslash stands for a marker."""
        def part(x: Column) -> Column:
            for k, m in enumerate(self.markers):
                x = F.replace(x, F.lit(f"\\{k}"), F.lit(m))
            return x

        return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def format_turns(turns: DataFrame, key: str, template: Template = Template()) -> DataFrame:
    """key, formatted, loss_spans (start and length in code points, in order) of rows (key, at, role, text)."""
    role, text = template.escape(F.col("role")), template.escape(F.col("text"))
    head = F.concat(F.lit(template.open), role, F.lit(template.middle))
    rows = turns.select(F.col(f"`{key}`").alias("__key"), "at", "role", "text", head.alias("head"), text.alias("escaped"))
    rows = rows.select("__key", "at", "role", "text", F.concat("head", "escaped", F.lit(template.close)).alias("piece"), F.char_length("head").cast("bigint").alias("skip"), F.char_length("escaped").cast("bigint").alias("length"))
    w = W.partitionBy("__key").orderBy("at", "role", "text")
    size = F.char_length("piece").cast("bigint")
    placed = rows.select("__key", F.row_number().over(w).alias("n"), "piece", F.col("role").isin(*template.learn).alias("learn"), (F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)) - size + F.col("skip")).alias("start"), "length")
    whole = placed.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "learn", "start", "length"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"], x["length"]))
    return whole.select(F.col("__key").alias(key), F.array_join(F.col("t.piece"), "").alias("formatted"), spans.alias("loss_spans"))


def read_transcripts(transcripts: DataFrame, template: Template = Template()) -> DataFrame:
    """transcripts, with turns (role, text) and loss_text (what the mask covers) read back from formatted and loss_spans."""
    def turn(piece: Column) -> Column:
        at = F.locate(template.middle, piece)
        role = F.substring(piece, F.lit(len(template.open) + 1), at - len(template.open) - 1)
        return F.struct(template.unescape(role).alias("role"), template.unescape(F.substring(piece, at + len(template.middle), F.char_length(piece))).alias("text"))

    pieces = F.split("formatted", re.escape(template.close))
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)  # nothing stands after the last close
    under = F.transform("loss_spans", lambda s: template.unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return transcripts.withColumns({"turns": turns, "loss_text": F.array_join(under, "")})


def chat_digests(transcripts: DataFrame, key: str, template: Template = Template()) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read back from the transcripts."""
    read = read_transcripts(transcripts, template)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(key, F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))


#: What both turns of the conversation that the report adds say.
PLANTED = "\\### Assistant: </turn> ok"


def chat_report(spark: SparkSession, conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """The digests of all conversations (conv_id, turn, role, text), whose rows are records of one turn, and of one more, in messages."""
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    messages = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(PLANTED).alias("content")) for role in ("user", "assistant")])
    more = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))
    turns = canonical_turns(rows.unionByName(more)).select("conv_id", F.inline("turns"))
    transcripts = Scratch(spark, "chat").table(format_turns(turns, "conv_id", template), "transcripts")
    return chat_digests(transcripts, "conv_id", template)


#: DuckDB SQL for the columns of the contract.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
e AS (SELECT *, [replace(replace(replace(replace(x, '\', '\\'), '<turn>', '\0'), '<text>', '\1'), '</turn>' || chr(10), '\2') FOR x IN [role, text]] AS x FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x[1]) + length(x[2]) + 20) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
