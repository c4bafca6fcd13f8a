"""Chat formatting: a finite-state machine over roles and a declarative template (DataFrame functions only).

The template gives, for each role, what opens and closes a turn and whether its text bears loss. ``format_chats``
orders a conversation's rows by turn, runs the roles through ``TRANSITIONS`` and emits segments
``(text, loss)`` whose concatenation is the formatted conversation, with the loss spans in code points.
Turn order is validated, not enforced: ``valid`` says whether every step was allowed and ``bad_turn`` is the place of the
first that wasn't. Every control string starts with ``<`` or ``[``; texts and roles are escaped so that neither
occurs in them, and ``unescape`` gives them back exactly.

Nulls: a null text or role is empty text, which has a turn as any other; null turns come first; ties of turns are ordered by role,
then text, and repeated rows are turns of their own; a null conv_id is a conversation of its own. Very long texts are formatted whole.
An empty table gives no rows. Other columns are ignored.
One conversation is one row by its contract, so its turns meet in one task; conversations are spread by conv_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing control strings of a turn; roles whose texts bear loss.
TEMPLATE = {"start": "<s>", "open": "[TURN ", "head": "]", "close": "</s>", "loss": ("assistant",)}
#: Allowed steps of the machine: state then role gives the next state; all else is an error.
TRANSITIONS = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
FINAL = ("assistant",)


def escape(text: Column) -> Column:
    """No < or [ in the result; a backslash starts every escape."""
    for raw, code in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``. Escaped text splits at double backslashes into parts that have single ones only."""

    def part(x: Column) -> Column:
        for raw, code in (("<", "\\l"), ("[", "\\b"), ("]", "\\e")):
            x = F.replace(x, F.lit(code), F.lit(raw))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def format_chats(rows: DataFrame, template: dict = TEMPLATE, transitions: dict = TRANSITIONS) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, length>> (0-based code points), segments, valid, bad_turn."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = rows.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    steps = F.create_map(*[F.lit(x) for state, to in transitions.items() for role_, next_ in to.items() for x in (f"{state}\n{role_}", next_)])
    walk = F.aggregate(
        "turns",
        F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(-1).alias("bad")),
        lambda acc, t: F.struct(
            F.coalesce(F.try_element_at(steps, F.concat_ws("\n", acc["state"], t["role"])), t["role"]).alias("state"),
            (acc["n"] + 1).alias("n"),
            F.when((acc["bad"] < 0) & F.try_element_at(steps, F.concat_ws("\n", acc["state"], t["role"])).isNull(), acc["n"]).otherwise(acc["bad"]).alias("bad"),
        ),
    )
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.array(
                part(F.concat(F.when(i == 0, F.lit(template["start"])).otherwise(F.lit("")), F.lit(template["open"]), escape(t["role"]), F.lit(template["head"])), no),
                part(escape(t["text"]), t["role"].isin(*template["loss"])),
                part(F.lit(template["close"]), no),
            ),
        )
    )
    chats = chats.withColumn("walk", walk).withColumn("segments", segments)
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("found")),
        lambda acc, s: F.struct(
            (acc["at"] + F.char_length(s["text"])).alias("at"),
            F.when(s["loss"], F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), F.char_length(s["text"]).cast("long").alias("length"))))).otherwise(acc["found"]).alias("found"),
        ),
    )["found"]
    valid = (F.col("walk.bad") < 0) & F.element_at("turns", -1)["role"].isin(*FINAL)
    return chats.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        "segments",
        valid.alias("valid"),
        F.when(F.col("walk.bad") >= 0, F.col("walk.bad")).alias("bad_turn"),
    )


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> parsed from a formatted conversation."""
    body = F.substr(formatted, F.lit(len(template["start"]) + 1), F.char_length(formatted))
    quoted = "".join("\\" + c if not c.isalnum() else c for c in template["close"])
    turns = F.split(body, quoted, -1)
    turns = F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0)))  # nothing after the last close

    def turn(x: Column) -> Column:
        head = F.instr(x, template["head"])
        role = F.substr(x, F.lit(len(template["open"]) + 1), head - 1 - len(template["open"]))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(x, head + len(template["head"]), F.char_length(x))).alias("text"))

    return F.transform(turns, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, cut from the formatted conversation."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
