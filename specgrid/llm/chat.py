"""Chat formatting from a declarative template, with turn-order states and loss flags.

DataFrame functions only. A finite-state machine over the roles checks the turn
order; the template says for each role what stands before and after its text
and whether the text counts for the loss. The output of a conversation is its
list of text segments with a flag each; joined they are the formatted string.

Control strings inside texts are escaped reversibly: ``<``, any number of
backslashes, ``|`` gets one backslash more, so ``<|`` never occurs in an escaped
text; undoing takes one away. In a role name ``%`` and line feed are also
written as ``%25`` and ``%0A``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Template:
    """What is written around a turn, whose text is learned, and which role may follow which."""

    before: str = START
    after_role: str = "\n"
    after: str = END + "\n"
    learned: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; a pair that is missing rejects the conversation.
    steps: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    #: States in which a conversation may end.
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()
REJECTED = "rejected"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*\|)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*\|)", r"<$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """``conv_id, n_turns, segments, formatted, end_state, valid`` for every conversation.

    ``rows(conv_id, turn, role, text)`` may come in any order. Turns are sorted
    by turn (nulls first), ties by role, then text; repeated rows stay repeated.
    A null text or role counts as empty; rows with a null conv_id form one
    conversation. ``segments`` is ``array<struct<text, loss>>``: for each turn
    its head, its escaped text, its end; ``formatted`` is their concatenation.
    The roles run through the template's state machine: ``end_state`` is the
    state after the last turn or ``rejected``, ``valid`` whether it is a final
    one. Conversations out of order are flagged, not dropped. Extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = rows.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    steps = F.create_map(*[F.lit(x) for (state, role), to in template.steps.items() for x in (f"{state}\n{role}", to)])

    def step(state: Column, turn: Column) -> Column:
        # A role with a line feed must not look like another pair.
        key = F.concat(state, F.lit("\n"), F.replace(turn["role"], F.lit("\n"), F.lit("\r")))
        return F.coalesce(F.try_element_at(steps, key), F.lit(REJECTED))

    def segments(turn: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(template.before), escape_role(turn["role"]), F.lit(template.after_role)), F.lit(False)),
            part(escape(turn["text"]), turn["role"].isin(*template.learned)),
            part(F.lit(template.after), F.lit(False)),
        )

    chats = chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate("turns", F.lit("start"), step).alias("end_state"),
    )
    return chats.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")).withColumn(
        "valid", F.col("end_state").isin(*template.final)
    )


def read_back(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """Adds ``turns: array<struct<role, text>>`` and ``learned: string``, both read from the output.

    The turns come from the formatted string alone, the learned text from the
    segments whose flag is set.
    """
    pieces = F.split("formatted", _quoted(template.after))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(template.before) + 1, 1 << 30)
        role = F.substring_index(body, template.after_role, 1)
        text = body.substr(F.length(role) + len(template.after_role) + 1, F.length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return chats.withColumns({"turns": F.transform(pieces, turn), "learned": F.array_join(learned, "")})


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def chat_digests(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """Counts and digests of every conversation, read back from its formatted form."""
    back = read_back(format_chats(rows, template), template)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
