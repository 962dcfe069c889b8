"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions alone.

Rows are ordered within a conversation by turn, then role, then text. The machine reads the roles in that order:
its state is the last role, and the pair (state, role) must be a transition. A conversation with a bad transition is
still formatted; valid is false and first_bad names the first such place.

Each turn gives three segments: the mark that opens it with its role, its escaped text, the mark that closes it. Only
the texts of roles under loss carry the loss flag. Control strings and the escape character inside roles and texts are
replaced by a backslash and a letter, so the marks occur nowhere else and the output can be read back.

Cases: null text and null role count as empty; null turns come first and null conv_id is a conversation of its own;
repeated rows are repeated turns; empty texts keep their turn; other columns are ignored; no rows give no result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    opening: str = "### "
    after_role: str = ":\n"
    closing: str = "</turn>"
    #: Control strings and the letters that stand for them after the escape character; the escape itself comes first.
    escapes: tuple = (("\\", "b"), ("###", "h"), ("</turn>", "t"), (":\n", "n"))
    loss_roles: tuple = ("assistant",)
    start: str = "<start>"
    transitions: dict = field(
        default_factory=lambda: {
            "<start>": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    final: tuple = ("assistant",)


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    for control, letter in template.escapes:
        text = F.replace(text, F.lit(control), F.lit("\\" + letter))
    return text


def unescape(text: Column, template: Template = CHAT) -> Column:
    for control, letter in reversed(template.escapes):
        text = F.replace(text, F.lit("\\" + letter), F.lit(control))
    return text


def format_conversations(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, n_turns, segments array<struct<text, loss>>, formatted, valid, first_bad) of conversations."""
    blank = lambda c: F.coalesce(rows[c].cast("string"), F.lit(""))
    turns = rows.select(rows["conv_id"].alias("conv_id"), F.struct(rows["turn"].alias("turn"), blank("role").alias("role"), blank("text").alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.opening), escape(t["role"], template), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
                F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    roles = F.col("turns.role")
    before = F.concat(F.array(F.lit(template.start)), F.slice(roles, 1, F.greatest(F.size(roles) - 1, F.lit(0))))
    allowed = F.array(*[F.array(F.lit(a), F.lit(b)) for a, bs in template.transitions.items() for b in bs])
    steps = F.arrays_zip(before.alias("state"), roles.alias("role"))
    bad = F.array_position(F.transform(steps, lambda s: F.array_contains(allowed, F.array(s["state"], s["role"]))), False)
    ends = F.element_at(roles, -1).isin(*template.final)
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        segments.alias("segments"),
        ((bad == 0) & ends).alias("valid"),
        F.when(bad > 0, bad - 1).alias("first_bad"),
    ).withColumn("formatted", F.array_join("segments.text", ""))


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Turns from the formatted text, and the text under the loss mask from the flagged segments."""
    parts = F.split(F.col("formatted"), "\\Q" + template.closing + "\\E")
    bodies = F.slice(parts, 1, F.size(parts) - 1)  # what follows the last mark is empty
    cut = len(template.after_role)

    def turn(body: Column) -> Column:
        rest = F.substring(body, len(template.opening) + 1, 2**31 - 1)
        at = F.instr(rest, template.after_role)
        role, text = F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + cut, F.lit(2**31 - 1))
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return formatted.select("conv_id", F.transform(bodies, turn).alias("turns"), masked.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_bad")


def digests(read: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "first_bad",
    )
