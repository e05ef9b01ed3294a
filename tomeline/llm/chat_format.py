"""Chat formatting by schema fingerprints.

Records come as JSON in any known layout: messages with role and content, conversations with from and value,
prompt and response, instruction with input and output. The nested field paths of a record, without its
values, are hashed; the fingerprint selects a declarative mapping (JSON paths and role names) that
turns the record into canonical turns. Turns are then written in one template:

* user: ``[INST] text [/INST]``; assistant: ``<s>text</s>``; any other role: ``<<ROLE>>role<</ROLE>>text<<END>>``;
* inside a text or role a backslash is doubled, and a control string gets one behind its first character, so
  that no control string is left in it; dropping the first of every backslash pair brings all back.

The loss mask is kept beside the text as segments (text, under loss): assistant texts are under loss.

Defined cases: null text and role are empty; a record of an unknown layout or broken JSON has null turns and null
output and ``layout`` null; a record without turns gives an empty text. Turns with one number are ordered by role, then text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>", "<<END>>"]
_CONTROL = r"([<\[])(/?INST\]|/?s>|</?ROLE>>|<END>>)"
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<ROLE>>.*?<</ROLE>>.*?<<END>>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``items`` is the JSON path of a list with the fields ``role`` and ``text``; without it, ``fields`` names
    the paths that are turns themselves, in order, each with its role. A path of ``optional`` gives no turn when
    empty, and is joined to the turn before it when ``joined``.
    """

    name: str
    shapes: tuple[str, ...]
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    joined: tuple[str, ...] = ()


MAPPINGS = [
    Mapping("messages", ("OBJECT<messages: ARRAY<OBJECT<content: _, role: _>>>", "OBJECT<messages: ARRAY<_>>"), "messages", "role", "content"),
    Mapping("conversations", ("OBJECT<conversations: ARRAY<OBJECT<from: _, value: _>>>", "OBJECT<conversations: ARRAY<_>>"), "conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt_response", ("OBJECT<prompt: _, response: _>",), fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("instruction", ("OBJECT<input: _, instruction: _, output: _>",), fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")), joined=("input",)),
]


def shape(record: Column) -> Column:
    """The nested field paths of a JSON text, written as one nested shape without values or scalar types.

    ``{"messages": [{"role": .., "content": ..}]}`` gives ``OBJECT<messages: ARRAY<OBJECT<content: _, role: _>>>``:
    fields in order of name, list members merged. Broken JSON gives null.
    """
    scalar = r"(: |<|^)(?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|UUID|VARIANT|DECIMAL\([0-9,]+\))(?=[,>]|$)"
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), scalar, "$1_")


def fingerprint(shape_: Column) -> Column:
    return F.sha2(shape_, 256)


def turns_by(mapping: Mapping, record: Column) -> Column:
    """Canonical turns of a record of this mapping's layout."""
    if mapping.items:
        read = F.from_json(F.get_json_object(record, f"$.{mapping.items}"), f"array<struct<`{mapping.role}`:string,`{mapping.text}`:string>>")

        def turn(x: Column) -> Column:
            role = F.coalesce(x[mapping.role], F.lit(""))
            for theirs, ours in mapping.roles:
                role = F.when(x[mapping.role] == theirs, F.lit(ours)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(x[mapping.text], F.lit("")).alias("text"))

        return F.transform(read, turn)
    parts: list[tuple[Column, str]] = []
    for path, role in mapping.fields:
        value = F.coalesce(F.get_json_object(record, f"$.{path}"), F.lit(""))
        if path in mapping.joined:
            before, own = parts.pop()
            value, role = F.when(value == "", before).otherwise(F.concat(before, F.lit("\n"), value)), own
        parts.append((value, role))
    return F.array(*[F.struct(F.lit(role).alias("role"), value.alias("text")) for value, role in parts])


def canonical_turns(rows: DataFrame, record: str = "record", mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """Rows with ``layout`` and ``turns``, by the mapping that the fingerprint of the record selects."""
    print_ = fingerprint(shape(F.col(record)))
    named = F.create_map(*[x for m in mappings for s in m.shapes for x in (fingerprint(F.lit(s)), F.lit(m.name))])
    out = rows.withColumn("layout", F.element_at(named, print_))
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        turns = F.when(F.col("layout") == m.name, turns_by(m, F.col(record))).otherwise(turns)
    return out.withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(turns: Column) -> Column:
    """The template's output as segments of (text, under loss), in order."""
    kind = "array<struct<text:string,loss:boolean>>"

    def seg(text: Column, loss: bool = False) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def one(x: Column) -> Column:
        text, role = escape(x["text"]), escape(x["role"])
        return (
            F.when(x["role"] == "user", F.array(seg(F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))))
            .when(x["role"] == "assistant", F.array(seg(F.lit("<s>")), seg(text, True), seg(F.lit("</s>"))))
            .otherwise(F.array(seg(F.concat(F.lit("<<ROLE>>"), role, F.lit("<</ROLE>>"), text, F.lit("<<END>>")))))
            .cast(kind)
        )

    return F.flatten(F.transform(turns, one))


def format_chat(rows: DataFrame, turns: str = "turns") -> DataFrame:
    """Rows with ``segments`` and ``formatted``, their texts in a row."""
    out = rows.withColumn("segments", segments(F.col(turns)))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text."""
    inside = lambda t, a, b: F.substring(t, F.lit(len(a) + 1), F.length(t) - len(a) - len(b))

    def turn(t: Column) -> Column:
        other = inside(t, "<<ROLE>>", "<<END>>")
        role = (
            F.when(t.startswith("[INST]"), F.lit("user")).when(t.startswith("<s>"), F.lit("assistant"))
            .otherwise(unescape(F.substring_index(other, "<</ROLE>>", 1)))
        )
        text = (
            F.when(t.startswith("[INST]"), inside(t, "[INST] ", " [/INST]")).when(t.startswith("<s>"), inside(t, "<s>", "</s>"))
            .otherwise(F.substring_index(other, "<</ROLE>>", -1))
        )
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def loss_text(segments_: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments_, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
