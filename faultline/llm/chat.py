"""Chat formatting: heterogeneous layouts to canonical turns, to one marked text and back.

A record's layout is known by the hash of its nested field paths. The hash selects a
declarative mapping, which says where the turns are and what their fields and roles are
called; the mapping's expressions make canonical turns. Layouts of JSON records are told
apart row by row; a table whose rows are the turns themselves has one fingerprint.

The formatted text of a conversation is, for each turn,

    <s>[ROLE]role[/ROLE]text</s>

and a control string inside a role or text is kept apart by a backslash after its first
character, one more than it had: `</s>` is written `<\\/s>`, `<\\/s>` is written `<\\\\/s>`.
The loss mask covers what assistants say. Only DataFrame functions are used.
"""

from __future__ import annotations

import dataclasses

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[ROLE]", "[/ROLE]"
#: Roles whose texts are learned from.
LEARNED = ("assistant",)
TURNS = "array<struct<role:string,text:string>>"
#: Names of roles in common layouts and what they are called here.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}

# First character, backslashes, rest of a control string; foreign control strings of common templates are kept apart as well.
_CONTROL = r"([<\[])(\\*)(/?s>|/?ROLE\]|/?INST\]|\|)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(/?s>|/?ROLE\]|/?INST\]|\|)", "$1$2$3")


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all fields below a type, arrays as [], in sorted order."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


@dataclasses.dataclass(frozen=True)
class Layout:
    """Where the turns of a JSON record are.

    `turns`: path of an array, with `role` and `text` as fields of its elements; or, without
    it, `fields`: (role, path) pairs in order, of which those that are null or blank make no turn
    unless they are the record's only ones.
    """

    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()

    def expression(self, record: Column) -> Column:
        """Canonical turns of a variant record."""
        if self.turns:
            items = F.try_variant_get(record, f"$.{self.turns}", "array<variant>")
            return F.transform(items, lambda x: F.struct(_role(F.try_variant_get(x, f"$.{self.role}", "string")).alias("role"), F.coalesce(F.try_variant_get(x, f"$.{self.text}", "string"), F.lit("")).alias("text")))
        got = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit("")).alias("text")) for role, path in self.fields])
        return F.filter(got, lambda x: F.trim(x["text"]) != "")


def _role(name: Column) -> Column:
    name = F.coalesce(name, F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(name)), name)


#: The layouts that are common in public instruction data.
LAYOUTS = (
    Layout(("messages[].content", "messages[].role"), turns="messages"),
    Layout(("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Layout(("conversation[].content", "conversation[].role"), turns="conversation"),
    Layout(("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout(("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout(("input", "instruction", "output"), fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
    Layout(("answer", "question", "system"), fields=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
)


def _nested(value: Column) -> Column:
    """The variant schema of an array or object, with a colon ahead; empty for other values."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.concat(F.lit(":"), kind)).otherwise(F.lit(""))


def record_paths(record: Column) -> Column:
    """Sorted nested field paths of a variant record, joined by commas: objects to their second
    level and the objects in their arrays. What is nested deeper ends its path with its variant
    schema, to full depth, so no layout that reads plain values there has such a path. Null
    values have paths as others do."""
    top = F.map_entries(F.try_variant_get(record, "$", "map<string,variant>"))

    def keys(x: Column) -> Column:
        return F.transform(F.map_entries(F.try_variant_get(x, "$", "map<string,variant>")), lambda f: F.concat(F.lit("."), f["key"], _nested(f["value"])))

    def below(e: Column) -> Column:
        items = F.try_variant_get(e["value"], "$", "array<variant>")
        fields = F.array_distinct(F.flatten(F.transform(items, lambda x: F.coalesce(keys(x), F.array(_nested(x))))))
        inner = keys(e["value"])
        return (
            F.when(F.size(fields) > 0, F.transform(fields, lambda k: F.concat(e["key"], F.lit("[]"), k)))
            .when(F.size(inner) > 0, F.transform(inner, lambda k: F.concat(e["key"], k)))
            .otherwise(F.array(F.concat(e["key"], _nested(e["value"]))))
        )

    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(top, below)))), ",")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def _hashed(paths: list[str]) -> int:
    h = xxhash.xxh64_intdigest(",".join(sorted(paths)).encode(), seed=42)
    return h - (h >> 63 << 64)


def schema_fingerprint(schema: T.DataType) -> int:
    """What fingerprint() gives for the field paths of a schema."""
    return _hashed(field_paths(schema))


def canonical_turns(records: DataFrame, *, json_col: str = "json", layouts: tuple[Layout, ...] = LAYOUTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns, fingerprint and turns of JSON records; turns are null where no layout fits or the text is no JSON object.

    The keys by which a conversation is numbered or its source is named (id, source and the
    like) belong into `keep` columns, not into the record: every path counts for the layout.
    """
    parsed = records.select(*keep, F.try_parse_json(F.col(json_col)).alias("__record"))
    parsed = parsed.withColumn("__fingerprint", fingerprint(record_paths(F.col("__record"))))
    turns = F.lit(None).cast(TURNS)
    for layout in layouts:
        own = fingerprint(F.lit(",".join(sorted(layout.paths))))
        turns = F.when(F.col("__fingerprint") == own, layout.expression(F.col("__record"))).otherwise(turns)
    return parsed.select(*keep, F.col("__fingerprint").alias("fingerprint"), turns.alias("turns"))


@dataclasses.dataclass(frozen=True)
class TurnTable:
    """Which columns of a table with a row for each turn say what; `named` if roles go by the names in ROLES."""

    conv: str
    turn: str
    role: str
    text: str
    named: bool = False

    @property
    def fingerprint(self) -> int:
        return _hashed([self.conv, self.turn, self.role, self.text])

    def expression(self) -> Column:
        """Turn number, role and text of a row."""
        role = _role(F.col(self.role)) if self.named else F.coalesce(F.col(self.role).cast("string"), F.lit(""))
        return F.struct(F.col(self.turn).cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col(self.text).cast("string"), F.lit("")).alias("text"))


#: Mappings of tables with a row for each turn, by the fingerprint of the schema.
TURN_TABLES = {t.fingerprint: t for t in (
    TurnTable("conv_id", "turn", "role", "text"),
    TurnTable("conversation_id", "index", "role", "content"),
    TurnTable("id", "turn", "from", "value", named=True),
)}


def turns_of_rows(rows: DataFrame, *, columns: tuple[str, str, str, str] | None = None) -> DataFrame:
    """conv_id and turns (by turn, then role and text) of a table with a row for each turn.

    The mapping follows from the fingerprint of the schema's field paths: that of all of them, or
    the first one whose fingerprint those of its own names have, where there are other columns;
    or columns are given. Nested fields have paths of their own, so they match no mapping. Null
    roles and texts count as empty; rows that are the same are turns of their own. A
    conversation's turns come together in one row, as its text does: one of 100 million
    characters is what a row of Spark can hold with room to spare.
    """
    if columns is None:
        paths = field_paths(rows.schema)
        some = [t for f, t in TURN_TABLES.items() if f == _hashed([p for p in paths if p in (t.conv, t.turn, t.role, t.text)])]
        layout = TURN_TABLES.get(schema_fingerprint(rows.schema), some[0] if some else None)
        if layout is None:
            raise ValueError(f"no mapping for a table with the fields {field_paths(rows.schema)}")
    else:
        layout = TurnTable(*columns, named=columns[2] == "from")
    got = rows.groupBy(F.col(layout.conv).alias("conv_id")).agg(F.array_sort(F.collect_list(layout.expression())).alias("turns"))
    return got.select("conv_id", F.transform("turns", lambda x: F.struct(x["role"], x["text"])).alias("turns"))


def formatted(turns: Column) -> Column:
    """The marked text of canonical turns."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(BEGIN + OPEN), escaped(t["role"]), F.lit(CLOSE), escaped(t["text"]), F.lit(END))))


def parsed(text: Column) -> Column:
    """The canonical turns of a marked text."""
    parts = F.filter(F.split(text, END, -1), lambda x: x != "")
    close = F.lit(CLOSE)
    return F.transform(parts, lambda x: F.struct(
        unescaped(F.substring_index(F.substring(x, len(BEGIN + OPEN) + 1, F.length(x)), CLOSE, 1)).alias("role"),
        unescaped(F.substring(x, F.locate(CLOSE, x) + F.length(close), F.length(x))).alias("text")))


def loss_spans(text: Column, learned: tuple[str, ...] = LEARNED) -> Column:
    """(start, end) of what is learned from in a marked text, in code points, as escaped there."""
    parts = F.filter(F.split(text, END, -1), lambda x: x != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        role = unescaped(F.substring_index(F.substring(x, len(BEGIN + OPEN) + 1, F.length(x)), CLOSE, 1))
        end = acc["at"] + F.length(x)
        span = F.struct((acc["at"] + F.locate(CLOSE, x) - 1 + len(CLOSE)).alias("start"), end.alias("end"))
        return F.struct((end + len(END)).alias("at"), F.when(role.isin(*learned), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id and formatted of conversations with canonical turns; no turns give an empty text."""
    return conversations.select("conv_id", formatted(F.coalesce("turns", F.array().cast(TURNS))).alias("formatted"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from `formatted`."""
    back = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parsed(F.col("formatted")).alias("turns"), "formatted")
    masked = F.transform(loss_spans(F.col("formatted")), lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    back = back.select("conv_id", "formatted_chars", "turns", F.concat_ws("", masked).alias("loss"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
