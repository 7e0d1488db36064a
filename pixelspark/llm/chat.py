r"""Chat formatting by schema fingerprints.

A record's layout is recognised by a fingerprint: the hash of the nested field paths that it fills (`messages[].role`,
`instruction`, ...). Each known layout declares its paths and how its fields map to canonical turns; the fingerprint
selects the mapping, so one table may mix layouts. Turns are rendered as

    <turn ROLE>\nTEXT</turn>\n

Inside a text every control string (`<`, an optional `/`, any backslashes, `turn`) gets one backslash before `turn`, and
reading takes one away again, so texts come back exactly. In roles, `%`, `<`, `>` and line feeds are percent-encoded.

Rendering happens per record before the shuffle. A conversation whose turns are rows of their own is put together in
two steps, first blocks of `BLOCK_TURNS` consecutive turn numbers and then the blocks, so that a long conversation is not
gathered row by row in one task. The loss mask lists one span per turn in code points of the formatted text; it covers
the texts of assistant turns.

Edge cases: a null text or role is empty; a null turn number sorts first; turns with equal numbers sort by their
rendered form and are all kept, as are repeated rows; a column that a layout may do without may be absent; a record that
fills fields of several layouts takes the one that needs most; records that fill none give no turns and are counted in
n_unmatched rather than being dropped; a very long turn is escaped whole, and equal or null turn numbers are put together in one
block; an empty table gives an empty result; columns that no layout mentions are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, table

BLOCK_TURNS = 64
OPEN, HEAD_END, CLOSE = "<turn ", ">\n", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A record layout: fields that must be filled, fields that may be null (of which those in `present` must exist, the
    others may be absent), the nested paths that the filled ones must have, and the mapping to turns, given the columns there are."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    nested: tuple[str, ...]
    turns: Callable[[set[str]], Column]
    present: tuple[str, ...] = ()

    def path_sets(self, columns: set[str]) -> list[tuple[str, ...]]:
        """The sets of fields that a record of this layout may fill, of the columns there are."""
        optional = [x for x in self.optional if x in columns]
        some = chain.from_iterable(combinations(optional, k) for k in range(len(optional) + 1))
        return [tuple(sorted((*self.required, *x))) for x in some]

    def fits(self, schema: T.StructType) -> bool:
        return {*self.required, *self.present, *self.nested} <= set(field_paths(schema))

    def filled(self) -> Column:
        """Whether a record fills what this layout needs, whatever else it fills."""
        needed = [F.col(x).isNotNull() for x in self.required]
        return reduce(lambda a, b: a & b, needed) if needed else reduce(lambda a, b: a | b, [F.col(x).isNotNull() for x in self.present])


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def _listed(column: str, role: str, text: str) -> Callable[[set[str]], Column]:
    return lambda _: F.transform(F.col(column), lambda m: _turn(m[role], m[text]))


def _pair(asked: tuple[str, ...], answer: str) -> Callable[[set[str]], Column]:
    """A user turn of the asked fields that are there and not empty, and an assistant turn."""
    return lambda columns: F.array(_turn(F.lit("user"), F.concat_ws("\n\n", *[F.nullif(F.col(x).cast("string"), F.lit("")) for x in asked if x in columns])), _turn(F.lit("assistant"), F.col(answer)))


#: Where a record fills more than one layout needs, the one that needs most wins, and of equal ones the first here.
LAYOUTS = (
    Layout("messages", ("messages",), (), ("messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    Layout("from_value", ("conversations",), (), ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    Layout("instruction", ("instruction", "output"), ("input",), (), _pair(("instruction", "input"), "output")),
    Layout("prompt_response", ("prompt", "response"), (), (), _pair(("prompt",), "response")),
    Layout("prompt_completion", ("prompt", "completion"), (), (), _pair(("prompt",), "completion")),
    Layout("turn_rows", (), ("turn", "role", "text"), (), lambda _: F.array(_turn(F.col("role"), F.col("text"))), ("role", "text")),
)


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Every nested field path of a schema; arrays add [] to the path."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for here in [f"{prefix}.{f.name}" if prefix else f.name] for p in (here, *field_paths(f.dataType, here))]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return []


def layouts_of(schema: T.StructType, layouts: Sequence[Layout] = LAYOUTS) -> list[Layout]:
    return [x for x in layouts if x.fits(schema)]


def fingerprint(schema: T.StructType, layouts: Sequence[Layout]) -> Column:
    """Hash of the field paths that a record fills, among the fields that some layout knows."""
    paths = field_paths(schema)
    known = sorted({f for x in layouts for f in (*x.required, *x.optional)} & set(schema.names))
    nested = {p for x in layouts for p in x.nested}
    filled = [F.when(F.col(f).isNotNull(), F.lit(_with_nested(f, paths, nested))) for f in known]
    return F.xxhash64(F.concat_ws(",", *filled) if filled else F.lit(""))


def _with_nested(field: str, paths: Sequence[str], nested: set[str]) -> str:
    return ",".join([field, *sorted(p for p in paths if p in nested and p.startswith((f"{field}[", f"{field}.")))])


def canonical_turns(records: DataFrame, key: str = "conv_id", order: str = "turn", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """records as (conv_id, turn, layout, turns): the canonical turns of each record by its fingerprint's mapping."""
    here = layouts_of(records.schema, layouts)
    paths, columns = field_paths(records.schema), set(records.columns)
    nested = {p for x in here for p in x.nested}
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    # a record that fills fields of several layouts has a fingerprint of its own: what it fills decides, by precedence
    for x in sorted(reversed(here), key=lambda x: len(x.required)):
        name, turns = F.when(x.filled(), F.lit(x.name)).otherwise(name), F.when(x.filled(), x.turns(columns)).otherwise(turns)
    mark = F.col("__fingerprint")
    for x in reversed(here):
        hashes = [F.xxhash64(F.lit(",".join(_with_nested(f, paths, nested) for f in s))) for s in x.path_sets(columns)]
        chosen = reduce(lambda a, b: a | b, [mark == h for h in hashes])
        name, turns = F.when(chosen, F.lit(x.name)).otherwise(name), F.when(chosen, x.turns(columns)).otherwise(turns)
    number = F.col(order).cast("long") if order in records.columns else F.lit(0).cast("long")
    marked = records.withColumn("__fingerprint", fingerprint(records.schema, here))
    return marked.select(F.col(key).cast("long").alias("conv_id"), number.alias("turn"), name.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(/?)(\\*)turn", r"<$1\\$2turn")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(/?)\\(\\*)turn", "<$1$2turn")


def escape_role(role: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A")), role)


def unescape_role(role: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), (("\n", "%0A"), (">", "%3E"), ("<", "%3C"), ("%", "%25")), role)


def _span(start: Column, begin: Column, end: Column, loss: Column) -> Column:
    return F.struct(start.cast("long").alias("turn_start"), begin.cast("long").alias("start"), end.cast("long").alias("end"), loss.alias("loss"))


def _shift(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: _span(s["turn_start"] + by, s["start"] + by, s["end"] + by, s["loss"]))


SPANS = "array<struct<turn_start:bigint,start:bigint,end:bigint,loss:boolean>>"


def _join_parts(parts: Column) -> tuple[Column, Column, Column]:
    """Text, spans and length of parts (each with text, spans, chars) put one after another."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))
    moved = F.aggregate(parts, start, lambda acc, p: F.struct((acc["at"] + p["chars"]).alias("at"), F.concat(acc["spans"], _shift(p["spans"], acc["at"])).alias("spans")))
    return F.array_join(F.transform(parts, lambda p: p["text"]), ""), moved["spans"], moved["at"]


def render(turns: Column) -> Column:
    """Parts of the canonical turns: each turn's text with its markers, its span and its length."""

    def one(t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        head = F.concat(F.lit(OPEN), escape_role(role), F.lit(HEAD_END))
        return let(F.struct(head.alias("head"), escape(F.coalesce(t["text"], F.lit(""))).alias("body"), (role == "assistant").alias("loss")), part)

    def part(x: Column) -> Column:
        begin = F.length(x["head"])
        end = begin + F.length(x["body"])
        return F.struct(F.concat(x["head"], x["body"], F.lit(CLOSE)).alias("text"), F.array(_span(F.lit(0), begin, end, x["loss"])).alias("spans"), (end + len(CLOSE)).cast("long").alias("chars"))

    return F.transform(turns, one)


def format_chats(records: DataFrame, key: str = "conv_id", order: str = "turn", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """One row per conversation: conv_id, formatted text, loss_mask spans, n_turns, layouts met, n_unmatched records."""
    rows = canonical_turns(records, key, order, layouts).withColumn("parts", render(F.col("turns")))
    text, spans, chars = _join_parts(F.col("parts"))
    unmatched = F.when(F.col("layout").isNull(), 1).otherwise(0).cast("long").alias("n_unmatched")
    rows = rows.select("conv_id", "turn", "layout", unmatched, text.alias("text"), spans.alias("spans"), chars.alias("chars"))

    def gather(df: DataFrame, by: list[str], at: str) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct(F.col(at), F.col("text"), F.col("spans"), F.col("chars"))))
        grouped = df.groupBy(*by).agg(parts.alias("parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("layouts")))).alias("layouts"), F.sum("n_unmatched").alias("n_unmatched"))
        text, spans, chars = _join_parts(F.col("parts"))
        return grouped.select(*by, "layouts", "n_unmatched", text.alias("text"), spans.alias("spans"), chars.alias("chars"))

    rows = rows.withColumns({"block": F.floor(F.col("turn") / BLOCK_TURNS), "layouts": F.array_compact(F.array("layout"))})
    whole = gather(gather(rows, ["conv_id", "block"], "turn"), ["conv_id"], "block")
    return whole.select("conv_id", F.col("text").alias("formatted"), F.col("spans").alias("loss_mask"), F.size("spans").cast("long").alias("n_turns"), "layouts", "n_unmatched")


def read_turns(formatted: Column) -> Column:
    """The rendered turns of a formatted text, each without its end marker."""
    pieces = F.split(formatted, CLOSE, -1)
    return let(pieces, lambda p: F.slice(p, F.lit(1), F.size(p) - 1))


def read_role(turn: Column) -> Column:
    return unescape_role(F.substring(turn, F.lit(len(OPEN) + 1), F.instr(turn, HEAD_END) - len(OPEN) - 1))


def read_text(turn: Column) -> Column:
    return unescape(F.substring(turn, F.instr(turn, HEAD_END) + len(HEAD_END), F.length(turn)))


def read_loss_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order; null where the mask's offsets are not those of the formatted text."""
    both = F.arrays_zip(read_turns(formatted).alias("turn"), loss_mask.alias("span"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("true"))
    walked = F.aggregate(both, start, lambda acc, x: F.struct((acc["at"] + F.length(x["turn"]) + len(CLOSE)).cast("long").alias("at"), (acc["true"] & F.coalesce(x["span"]["turn_start"] == acc["at"], F.lit(False))).alias("true")))
    trained = F.filter(both, lambda x: x["span"]["loss"])
    texts = F.transform(trained, lambda x: unescape(F.substring(x["turn"], (x["span"]["start"] - x["span"]["turn_start"] + 1).cast("int"), (x["span"]["end"] - x["span"]["start"]).cast("int"))))
    return F.when(walked["true"] & (walked["at"] == F.length(formatted)), F.array_join(texts, ""))


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, as digests."""
    back = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(read_role(t), F.lit("\n"), read_text(t), F.lit("\n"))), "")
    read = chats.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(back.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )


PLANTED = r"\### Assistant: </turn> ok"


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return digests(format_chats(rows.unionByName(planted)))


QUERIES = {"op2_chat_format": op2_chat_format}
ORACLES = {
    "op2_chat_format": rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), chr(10), '%0A') AS safe_role,
    regexp_replace(text, '<(/?)(\\*)turn', '<\1\\\2turn', 'g') AS safe_text FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(HEAD_END) + len(CLOSE)} + length(safe_role) + length(safe_text))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
}
