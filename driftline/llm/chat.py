"""Chat formatting with a grammar round trip.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; a conversation is its turns
in order. Each turn is rendered as it stands, read again by the parser and
compared with its source. A turn that does not come back has its text escaped:
every ``<|``, also with backslashes between, gets one more backslash there,
and the parser takes one away. Escaped text holds no control string, and
adding and removing one backslash is exact, so the second reading is
identical. Whole conversations are parsed again at the end.

Defined results:

* null text: empty; null role: empty; null turn: after all others of its conversation;
* null conversation id: one conversation of its own;
* repeated rows: turns of their own; equal turns are ordered by role, then text;
* roles with other characters than letters, digits and ``_``: percent-encoded in the header;
* empty table: empty result; further columns: not part of a conversation.

A conversation is one string in one row, so its turns meet in one task; how
long it may be is a matter of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def header(role: Column) -> Column:
    return F.concat(F.lit(START), F.when(role.rlike("^[A-Za-z0-9_]*$"), role).otherwise(F.url_encode(role)),
                    F.lit("\n"))


def render(role: Column, body: Column) -> Column:
    return F.concat(header(role), body, F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """Turns of a rendered string as (role, text); a part that breaks the grammar has a null text."""
    def turn(part):
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part))
        length = F.length(body) - len(END) - 1
        whole = body.endswith(END + "\n") & (F.instr(body, END) == length + 1)
        return F.struct(F.try_url_decode(role).alias("role"),
                        F.when(whole, unescape(F.substring(body, F.lit(1), length))).alias("text"))

    parts = F.split(rendered, r"<\|im_start\|>")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def comes_back(rendered: Column, role: Column, text: Column) -> Column:
    return parse(rendered).eqNullSafe(F.array(F.struct(role.alias("role"), text.alias("text"))))


def render_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """Each turn with its rendered form, escaped only where the plain form does not come back."""
    turns = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                      F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    plain = turns.withColumn("plain", render(F.col("role"), F.col("text")))
    body = F.when(comes_back(F.col("plain"), F.col("role"), F.col("text")), F.col("text")).otherwise(
        escape(F.col("text")))
    return plain.withColumn("body", body).drop("plain").withColumn("rendered", render(F.col("role"), F.col("body")))


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted``, the loss mask and whether it reads back as its source.

    The mask ``loss`` lists (start, length) in code points of ``formatted``, one
    span per turn of the role to learn from. Offsets come from a running sum
    and use the same shuffle as the grouping.
    """
    turns = render_turns(df, conv_id, turn, role, text)
    place = [F.col("turn").isNull().alias("last"), F.col("turn"), F.col("role"), F.col("text")]
    before = Window.partitionBy("conv_id").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(
        F.sum(F.length("rendered").cast("long")).over(before), F.lit(0)))
    span = F.struct((F.col("start") + F.length(header(F.col("role")))).alias("start"),
                    F.length("body").cast("long").alias("length"))
    turns = turns.withColumn("span", F.when(F.col("role") == learn_from, span))
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "rendered", "span", "role", "text"))).alias("turns"))
    return grouped.select(
        "conv_id", F.array_join("turns.rendered", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    ).withColumn("identical", parse(F.col("formatted")).eqNullSafe(F.col("turns"))).drop("turns")


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with the parsed ``turns`` and ``loss_texts``, the unescaped text under the mask.

    A conversation that is not identical after escaping would be an error of
    the grammar and stops the job.
    """
    sound = F.assert_true("identical", F.lit("a conversation does not read back"))
    return formatted.filter(sound.isNull()).withColumns({
        "turns": parse(F.col("formatted")),
        "loss_texts": F.transform("loss", lambda s: unescape(F.substring(
            F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))})


def digests(parsed: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
