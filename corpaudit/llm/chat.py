"""Chat formatting by schema fingerprints, with DataFrame functions only.

Records of different layouts (prompt and response, instruction and output, lists of messages) stand in one table whose
columns are NULL where a record's layout lacks them. The set of filled field paths is a record's fingerprint; a
declarative mapping with the same fingerprint says where its turns are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

#: What marks the parts of a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings of this and other templates that a text must not contain as they are.
CONTROL = (OPEN, MIDDLE, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
#: Word joiner, invisible; breaks a control string behind its first character.
BREAK = "\u2060"

_TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout. ``turns`` are (role, path) pairs for layouts of single fields; for lists ``items`` names the array and
    ``role_field``, ``text_field`` the fields of its elements. ``optional`` paths may be filled or not."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str | None = None
    role_field: str | None = None
    text_field: str | None = None
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.items is not None:
            return [self.items, f"{self.items}[].{self.role_field}", f"{self.items}[].{self.text_field}"]
        return [path for _, path in self.turns]

    def variants(self) -> list[list[str]]:
        """The path sets that this mapping covers: each optional path there or not."""
        sets = [[]]
        for path in self.paths():
            sets = [s + [path] for s in sets] + ([list(s) for s in sets] if path in self.optional else [])
        return [sorted(s) for s in sets]


#: Common layouts by their public field names.
MAPPINGS = (
    Mapping("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", (("user", "prompt"), ("assistant", "completion"))),
    Mapping(
        "instruction", (("system", "system"), ("user", "instruction"), ("assistant", "output")), optional=("system",)
    ),
    Mapping("messages", items="messages", role_field="role", text_field="content"),
    Mapping(
        "conversations", items="conversations", role_field="from", text_field="value",
        roles=(("human", "user"), ("gpt", "assistant")),
    ),
)


def _filled(struct: T.StructType, at: Column | None, prefix: str) -> list[tuple[str, Column]]:
    """Every field path below a struct with the condition that it is filled; elements of arrays add up."""
    found = []
    for field in struct.fields:
        column = F.col(f"`{field.name}`") if at is None else at.getField(field.name)
        path = f"{prefix}{field.name}"
        found.append((path, column.isNotNull()))
        kind = field.dataType
        if isinstance(kind, T.StructType):
            found += _filled(kind, column, f"{path}.")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for name in kind.elementType.fieldNames():
                found.append((f"{path}[].{name}", _any_filled(column, name)))
    return found


def _any_filled(array: Column, name: str) -> Column:
    return F.coalesce(F.exists(array, lambda e: e.getField(name).isNotNull()), F.lit(False))


def field_paths(df: DataFrame, skip: Sequence[str]) -> Column:
    """The sorted paths of a record's filled fields, without the columns ``skip``."""
    struct = T.StructType([f for f in df.schema.fields if f.name not in skip])
    found = sorted(_filled(struct, None, ""), key=lambda p: p[0])
    if not found:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(filled, F.lit(path)) for path, filled in found]), lambda p: p.isNotNull())


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _turns(mapping: Mapping, columns: Sequence[str]) -> Column | None:
    """The canonical turns by one mapping; None where the table lacks its columns."""
    def named(role: Column) -> Column:
        for other, own in mapping.roles:
            role = F.when(role == other, own).otherwise(role)
        return F.coalesce(role, F.lit(""))

    if mapping.items is not None:
        if mapping.items not in columns:
            return None
        return F.transform(F.col(mapping.items), lambda e: F.struct(
            named(e.getField(mapping.role_field)).alias("role"),
            F.coalesce(e.getField(mapping.text_field), F.lit("")).alias("text"),
        )).cast(_TURN)
    if any(path not in columns and path not in mapping.optional for path in mapping.paths()):
        return None
    turns = [
        F.when(F.col(path).isNotNull(), F.struct(F.lit(role).alias("role"), F.col(path).alias("text")))
        for role, path in mapping.turns if path in columns
    ]
    return F.filter(F.array(*turns), lambda t: t.isNotNull()).cast(_TURN)


def canonical_turns(records: DataFrame, key: str, mappings: Sequence[Mapping] = MAPPINGS, keep: Sequence[str] = ()) -> DataFrame:
    """``key``, ``fingerprint``, ``layout`` and ``turns`` of every record; a map without a shuffle.

    Records whose fingerprint no mapping has get a NULL layout and NULL turns, so that they can be seen. ``keep`` names
    columns that are no part of the record.
    """
    records = records.withColumn("_paths", field_paths(records, [key, *keep]))
    mark = fingerprint(F.col("_paths"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURN)
    for mapping in mappings:
        selected = _turns(mapping, records.columns)
        if selected is not None:
            known = [fingerprint(F.array(*[F.lit(p) for p in paths])) for paths in mapping.variants() if paths]
            here = F.lit(False)
            for value in known:
                here = here | (mark == value)
            layout = F.when(here, mapping.name).otherwise(layout)
            turns = F.when(here, selected).otherwise(turns)
    return records.select(key, *keep, mark.alias("fingerprint"), layout.alias("layout"), turns.alias("turns"))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "|[]" else c for c in text)


def escaped(text: Column) -> Column:
    """One more break behind the first character of every control string, broken already or not.

    No control string has another's first character inside, so matches can't overlap, and one more or one fewer break
    leaves all other matches as they are: ``unescaped`` gives back any text.
    """
    return F.regexp_replace(text, f"([<\\[])(?={BREAK}*(?:{_rests()}))", f"$1{BREAK}")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[]){BREAK}(?={BREAK}*(?:{_rests()}))", "$1")


def _rests() -> str:
    return "|".join(_quoted(c[1:]) for c in CONTROL)


def formatted_chats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key``, ``formatted``, ``loss_spans`` from canonical ``turns``.

    A turn is OPEN role MIDDLE text CLOSE; roles and texts are escaped. ``loss_spans`` (start, length in code points
    from 0) cover each assistant text, in order. A record is one row with all of its turns, so it has to fit into
    memory; places come from a running sum within the row's turns, without a shuffle of other rows.

    NULL roles and texts count as empty. Records with NULL turns get a NULL text; with no turns, an empty one. Keys may
    repeat or be NULL: records are told apart by row. Other columns are not read.
    """
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), escaped(F.coalesce(t["role"], F.lit(""))), F.lit(MIDDLE)).alias("head"),
        escaped(F.coalesce(t["text"], F.lit(""))).alias("body"),
        (F.coalesce(t["role"], F.lit("")) == "assistant").alias("loss"),
    ))
    rows = turns.select(key, pieces.alias("_pieces"))
    lengths = F.transform("_pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + F.lit(len(CLOSE)))
    sums = F.aggregate(
        F.col("_lengths"), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")),
    )["starts"]
    spans = F.filter(
        F.zip_with("_pieces", "_starts", lambda p, s: F.when(p["loss"], F.struct(
            (s + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"),
        ))),
        lambda s: s.isNotNull(),
    )
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return (
        rows.withColumn("_lengths", lengths).withColumn("_starts", sums)
        .select(key, text.alias("formatted"), spans.alias("loss_spans"))
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns read back from a formatted text. Every turn ends with CLOSE, which leaves one empty part behind."""
    parts = F.slice(F.split(formatted, _quoted(CLOSE)), F.lit(1), F.size(F.split(formatted, _quoted(CLOSE))) - 1)
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), MIDDLE, 1)).alias("role"),
        unescaped(F.substring_index(p, MIDDLE, -1)).alias("text"),
    ))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped piece by piece."""
    return F.array_join(
        F.transform(spans, lambda s: unescaped(formatted.substr(s["start"] + 1, s["length"]))), ""
    )


def records_from_rows(rows: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns as records of the layouts that hold them: a user and an assistant turn as prompt and response; a
    system turn before these as an instruction; all else as messages. Equal turn numbers are ordered by role and text,
    NULL first; NULL roles and texts become empty. One conversation is one record, however many there are."""
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    grouped = rows.select(key, item.alias("item")).groupBy(key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    roles = F.transform("items", lambda i: i["role"])
    paired = roles == F.array(F.lit("user"), F.lit("assistant"))
    instructed = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    at = lambda n: F.get(F.col("items"), F.lit(n))["text"]
    return grouped.select(
        key,
        F.when(paired, at(0)).alias("prompt"), F.when(paired, at(1)).alias("response"),
        F.when(instructed, at(0)).alias("system"), F.when(instructed, at(1)).alias("instruction"),
        F.when(instructed, at(2)).alias("output"),
        F.when(~paired & ~instructed, F.transform("items", lambda i: F.struct(
            i["role"].alias("role"), i["text"].alias("content")
        ))).alias("messages"),
    )
