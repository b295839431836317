"""Chat formatting, with Spark expressions only.

Turns of a conversation are collected as structs and sorted; runs of turns with one role merge into a
message of several parts; messages are concatenated. Control strings in texts are escaped: every ``<``,
some backslashes, ``|`` gets one backslash more, so ``<|`` begins nothing but this template's own marks
and unescaping takes that one backslash away.

Edge cases: null text and null role count as empty; turns with the same number go by role, then text;
null turn numbers come first; a null conv_id is a conversation of its own; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PART, END, BREAK = "<|im_start|>", "<|im_part|>", "<|im_end|>", "<|im_nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _literal(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, messages (role, parts), segments (text, loss) and formatted.

    ``segments`` is the loss mask: joined they are ``formatted``, and those with ``loss`` are the
    assistant's texts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")))).alias("turns"))
    # a message begins wherever the role changes
    listed = listed.select("conv_id", "turns", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 OR turns[i].role <> turns[greatest(i, 1) - 1].role)").alias("begins"))
    merged = listed.select(
        "conv_id",
        F.expr("""transform(begins, (b, j) -> named_struct(
            'role', turns[b].role,
            'parts', transform(slice(turns, b + 1, coalesce(get(begins, j + 1), size(turns)) - b), t -> t.text)))""").alias("messages"),
    )
    piece = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    plain = lambda value: piece(value, F.lit(False))

    def segments(m: Column) -> Column:
        head = plain(F.concat(F.lit(START), F.replace(escape(m["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n")))
        spoken = lambda p: piece(escape(p), m["role"] == "assistant")
        parts = F.flatten(F.transform(m["parts"], lambda p, i: F.when(i == 0, F.array(spoken(p))).otherwise(F.array(plain(F.lit(PART)), spoken(p)))))
        return F.concat(F.array(head), parts, F.array(plain(F.lit(END + "\n"))))

    done = merged.withColumn("segments", F.flatten(F.transform("messages", segments)))
    return done.withColumn("formatted", F.array_join(F.col("segments")["text"], ""))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""

    def message(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END + "\n"))
        named = unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))
        return F.transform(F.split(body, _literal(PART), -1), lambda p: F.struct(named.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(F.slice(F.split(formatted, _literal(START), -1), 2, 1 << 30), message))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, the text under the loss mask, lengths."""
    return formatted.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("back"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("messages").cast("long").alias("n_messages"),
    ).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_messages",
    )
