"""Chat formatting of heterogeneous records, with DataFrame functions only.

A record's nested field paths are hashed to a fingerprint, and the fingerprint selects a declarative mapping that
turns the record's layout (messages, conversations, prompt and response, instruction) into canonical turns. A template
then marks the turns, escapes control strings inside texts reversibly, and gives the spans that bear loss.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Layout(NamedTuple):
    """Which paths a record of the layout has, and how its turns are read: a list of (path, role, text field, role
    field). Without fields the path itself is one turn's text, of the given role. ``path[]`` says that the path is a
    list, ``path[].field`` that some element of it has the field."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[tuple[str, str | None, str | None, str | None], ...]


LAYOUTS = (
    Layout("messages", ("messages", "messages[]"), ("messages[].role", "messages[].content", "system"), (("system", "system", None, None), ("messages", None, "content", "role"))),
    Layout("conversations", ("conversations", "conversations[]"), ("conversations[].from", "conversations[].value", "system"), (("system", "system", None, None), ("conversations", None, "value", "from"))),
    Layout("prompt", ("prompt",), ("response", "system"), (("system", "system", None, None), ("prompt", "user", None, None), ("response", "assistant", None, None))),
    Layout("instruction", ("instruction",), ("input", "output", "system"), (("system", "system", None, None), ("instruction", "user", None, None), ("input", "user", None, None), ("output", "assistant", None, None))),
)

#: Names that layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Strings that chat templates give a meaning; inside texts they are escaped.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_NAMES = {"<": "&lt;", "[": "&lbrack;"}

_OPEN, _NAMED, _CLOSE = "<|turn ", "|>\n", "<|end|>\n"
_TURN = r"(?s)<\|turn ([^|]*)\|>\n(.*?)<\|end\|>\n"


def escape(text: Column) -> Column:
    """Text without control strings: their first sign becomes a name. ``unescape`` gives the text back."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(_NAMES[control[0]] + control[1:]))
    return out


def unescape(text: Column) -> Column:
    for sign, name in _NAMES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.replace(F.replace(text, F.lit("&vert;"), F.lit("|")), F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("&vert;"))


#: Lists of turns, the fields their elements are known by, and the mark of an element that has none of them.
LISTS = ("messages", "conversations")
FIELDS = ("role", "content", "from", "value")
OTHER = "[].*"


def _elements(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "array<variant>")


def _has(field: str):
    return lambda e: F.coalesce(F.try_variant_get(e, f"$.{field}", "variant").isNotNull(), F.lit(False))


def fingerprint(record: Column) -> Column:
    """Hash of the known nested field paths that a record has; other fields don't change it.

    All elements of a list count: one that mixes the fields of two layouts, or holds something that is no turn, has
    paths that no layout declares.
    """
    plain = {p for layout in LAYOUTS for p in (*layout.required, *layout.optional) if "[" not in p}
    there = {p: F.try_variant_get(record, f"$.{p}", "variant").isNotNull() for p in plain}
    for path in LISTS:
        elements = _elements(record, path)
        there[f"{path}[]"] = elements.isNotNull()
        for field in FIELDS:
            there[f"{path}[].{field}"] = F.exists(elements, _has(field))
        there[path + OTHER] = F.exists(elements, lambda e: ~reduce(or_, [_has(f)(e) for f in FIELDS]))
    return F.xxhash64(F.concat_ws(",", *[F.when(there[p], F.lit(p)) for p in sorted(there)]))


def _select() -> Column:
    """Map from fingerprint to layout number."""
    entries = []
    for number, layout in enumerate(LAYOUTS):
        for n in range(len(layout.optional) + 1):
            for some in combinations(layout.optional, n):
                entries += [F.xxhash64(F.lit(",".join(sorted({*layout.required, *some})))), F.lit(number)]
    return F.create_map(*entries)


def _turn(role_field: str, text_field: str):
    def read(turn: Column) -> Column:
        said = F.try_variant_get(turn, f"$.{role_field}", "string")
        role = said
        if role_field == "from":
            for name, canonical in ROLES.items():
                role = F.when(said == name, F.lit(canonical)).otherwise(role)
        text = F.try_variant_get(turn, f"$.{text_field}", "string")
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    return read


def _turns(record: Column, layout: Layout) -> Column:
    parts = []
    for path, role, text_field, role_field in layout.turns:
        if text_field is None:
            value = F.try_variant_get(record, f"$.{path}", "string")
            one = F.array(F.struct(F.lit(role).alias("role"), value.alias("text")))
            parts.append(F.when(value.isNotNull(), one).otherwise(F.array().cast("array<struct<role:string,text:string>>")))
        else:
            parts.append(F.coalesce(F.transform(_elements(record, path), _turn(role_field, text_field)), F.array().cast("array<struct<role:string,text:string>>")))
    return F.concat(*parts)


def canonical_turns(df: DataFrame, record: str = "record") -> DataFrame:
    """``df`` with ``fingerprint``, ``layout`` and ``turns`` (role, text) of JSON records.

    A record whose fingerprint no layout declares, a broken or null one has null ``layout`` and ``turns``; its
    ``schema`` tells what it looks like. So has one whose list of turns is no list, mixes the fields of layouts or
    holds an element without any of them: no turn is lost without notice. Turns without role or text have an empty
    one; a text that is an object or a list is taken as its JSON. Other columns pass through; ``_parsed`` and
    ``_layout`` are reserved.
    """
    parsed = df.withColumn("_parsed", F.try_parse_json(record))
    keyed = parsed.withColumn("fingerprint", F.when(F.col("_parsed").isNotNull(), fingerprint(F.col("_parsed"))))
    chosen = keyed.withColumn("_layout", F.try_element_at(_select(), F.col("fingerprint")))
    turns, name = F.lit(None), F.lit(None)
    for number, layout in enumerate(LAYOUTS):
        turns = F.when(F.col("_layout") == number, _turns(F.col("_parsed"), layout)).otherwise(turns)
        name = F.when(F.col("_layout") == number, F.lit(layout.name)).otherwise(name)
    schema = F.when(F.col("_layout").isNull(), F.schema_of_variant("_parsed"))
    return chosen.withColumns({"layout": name, "turns": turns, "schema": schema}).drop("_parsed", "_layout")


def format_chat(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans`` (start and length in code points of ``formatted``).

    A turn is ``<|turn ROLE|>``, a line break, its escaped text and ``<|end|>`` with a line break. The texts of
    assistant turns bear loss, their marks do not. Null turns give null, no turn gives an empty string.
    """
    head = lambda t: F.concat(F.lit(_OPEN), _role(F.coalesce(t["role"], F.lit(""))), F.lit(_NAMED))
    pieces = F.transform(turns, lambda t: F.struct(head(t).alias("head"), escape(F.coalesce(t["text"], F.lit(""))).alias("body"), (t["role"] == "assistant").alias("loss")))
    made = df.withColumn("_pieces", pieces)
    formatted = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(_CLOSE))), "")
    # numbers only are carried along: where each turn begins, and its spans
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        n = F.length(p["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n + len(_CLOSE)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("_pieces", state, step)["spans"]
    return made.withColumns({"formatted": formatted, "loss_spans": spans}).drop("_pieces")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as they were before formatting."""
    roles = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))
    return F.transform(F.arrays_zip(roles.alias("r"), texts.alias("t")), lambda x: F.struct(unescape(x["r"]).alias("role"), unescape(x["t"]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before formatting."""
    part = lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, part), "")
