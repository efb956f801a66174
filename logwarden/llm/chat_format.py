"""Chat formatting: schema fingerprints select a declared mapping into canonical turns, which one template prints.

1. The nested field paths of a record that hold a value (``[]`` marks an array) are sorted and hashed: its fingerprint.
2. ``LAYOUTS`` maps fingerprints of known layouts to expressions that build ``turns: array<struct<role, text>>``. The
   choice is made per row, so one table may mix layouts.
3. ``render`` prints the turns. A turn is ``<|role|>``, a new line, the text, ``</s>`` and a new line. Inside roles and
   texts the escape sign and the first character of every control string are replaced (``~`` ``~0``, ``<`` ``~1``, ``[``
   ``~2``, ``|`` ``~3``), so that no text can open or close a turn. ``parse`` reads the turns back exactly.
4. ``loss_spans`` lists start and length (code points) of the assistant texts in the printed form.

Defined results: a null text or role is empty; turns of one conversation are ordered by turn, role and text, nulls
first, so repeated and tied rows keep a fixed order; rows without a conversation id form one conversation; a record of
an unknown layout keeps its row with null ``turns`` and ``layout``; further columns are ignored if they belong to no
layout. A conversation is one output row, so its turns are gathered in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.llm.columns import only

TURNS = "array<struct<role:string,text:string>>"
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "|>")
SIGNS = {"<": "~1", "[": "~2", "|": "~3"}


# -- schema fingerprints ------------------------------------------------------

@dataclass(frozen=True)
class Layout:
    name: str
    paths: tuple[str, ...]  # the paths that hold a value
    turns: Callable[[Column], Column]  # from the record


def turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"),
                    F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def listed(array: str, role: str, text: str) -> Callable[[Column], Column]:
    return lambda r: F.transform(r[array], lambda m: turn(canonical_role(m[role]), m[text]))


def canonical_role(role: Column) -> Column:
    """The role names of common layouts in canonical form; other names stay."""
    return F.when(role == "human", "user").when(role.isin("gpt", "bot", "model"), "assistant").otherwise(role)


def asked(*parts: tuple[str, str]) -> Callable[[Column], Column]:
    """Flat fields, one turn each; two fields of a role in a row are joined by an empty line."""
    def build(r: Column) -> Column:
        turns, texts = [], {}
        for role, field in parts:
            texts.setdefault(role, []).append(F.coalesce(r[field].cast("string"), F.lit("")))
        for role, fields in texts.items():
            turns.append(turn(role, F.concat_ws("\n\n", *fields)))
        return F.array(*turns)
    return build


def by_turn(r: Column) -> Column:
    return F.transform(F.array_sort(r["rows"]), lambda m: turn(m["role"], m["text"]))


LAYOUTS = (
    Layout("rows by turn", ("rows[].role", "rows[].text", "rows[].turn"), by_turn),
    Layout("messages", ("messages[].content", "messages[].role"), listed("messages", "role", "content")),
    Layout("from and value", ("conversations[].from", "conversations[].value"), listed("conversations", "from", "value")),
    Layout("prompt and completion", ("completion", "prompt"), asked(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), asked(("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), asked(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("input", "instruction", "output"),
           asked(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction with system", ("instruction", "output", "system"),
           asked(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("question and answer", ("answer", "question"), asked(("user", "question"), ("assistant", "answer"))),
    Layout("nested data", ("data.input", "data.output"),
           lambda r: F.array(turn("user", r["data"]["input"]), turn("assistant", r["data"]["output"]))),
)


def field_paths(schema: T.StructType, at: Column, prefix: str = "") -> dict[str, Column]:
    """For every leaf of a record: its path, and the path if it holds a value, else null. The leaves of an array of
    structs are the element fields that a layout names (``name[].field``); another array is one leaf, ``name[]``."""
    found = {}
    known = {p for layout in LAYOUTS for p in layout.paths}
    for f in schema:
        path, value = prefix + f.name, at[f.name]
        if isinstance(f.dataType, T.StructType):
            found |= field_paths(f.dataType, value, path + ".")
            continue
        paths = [path]
        if isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            names = [f"{path}[].{e.name}" for e in inner] if isinstance(inner, T.StructType) else []
            paths = [n for n in names if n in known] or [path + "[]"]
        found |= {p: F.when(value.isNotNull(), F.lit(p)) for p in paths}
    return found


def fingerprint(paths: Column) -> Column:
    """Hash of the sorted field paths."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(paths)), "\n"))


def known_names() -> set[str]:
    return {p.split(".")[0].removesuffix("[]") for layout in LAYOUTS for p in layout.paths}


def canonical_turns(records: DataFrame, id_column: str) -> DataFrame:
    """Per record: id, layout (its name), turns. Columns of no layout are ignored."""
    fields = [f for f in records.schema if f.name in known_names() and f.name != id_column]
    base = records.select(F.col(f"`{id_column}`").alias("id"), F.struct(
        *(F.col(f"`{f.name}`") for f in fields), F.lit(None).cast("int").alias("_none")).alias("r"))
    schema = T.StructType(fields)
    paths = field_paths(schema, F.col("r"))
    base = base.withColumn("fp", fingerprint(F.array(*(paths.values() or [F.lit(None).cast("string")]))))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        if set(layout.paths) <= paths.keys():
            fits = F.col("fp") == fingerprint(F.array(*map(F.lit, layout.paths)))
            name = F.when(fits, layout.name).otherwise(name)
            turns = F.when(fits, layout.turns(F.col("r")).cast(TURNS)).otherwise(turns)
    return base.select("id", name.alias("layout"), turns.alias("turns"))


# -- template -----------------------------------------------------------------

def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(SIGNS[control[0]] + control[1:]))
    return text


def unescape(text: Column) -> Column:
    for sign, code in SIGNS.items():
        text = F.replace(text, F.lit(code), F.lit(sign))
    return F.replace(text, F.lit("~0"), F.lit("~"))


def head(t: Column) -> Column:
    return F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n"))


def tail(t: Column) -> Column:
    return F.concat(escape(t["text"]), F.lit("</s>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), tail(t))), "")


def loss_spans(turns: Column) -> Column:
    """Start (from 0) and length of every assistant text in the printed form."""
    kind = "array<struct<start:long,length:long>>"
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin, size = state["at"] + F.length(head(t)), F.length(escape(t["text"])).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size + 5).alias("at"), F.when(
            t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, first, step, lambda state: state["spans"])


def parse(formatted: Column) -> Column:
    """The turns of a printed conversation."""
    parts = F.filter(F.split(formatted, "</s>\n"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "|>\n") + 3)).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, concatenated."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def gather(conversations: DataFrame) -> DataFrame:
    """Rows by turn as records: conv_id, rows (array of turn, role, text)."""
    rows = only(conversations, conv_id="long", turn="long", role="string", text="string")
    return rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("rows"))


def format_chats(records: DataFrame, id_column: str) -> DataFrame:
    """Per record: id, layout, turns, formatted, loss_spans."""
    return canonical_turns(records, id_column).withColumn("formatted", render(F.col("turns"))) \
        .withColumn("loss_spans", loss_spans(F.col("turns")))
