"""Chat formatting from event logs, with DataFrame functions only.

A log holds events (conv_id, seq, turn, kind, role, text).  Events are
partitioned by conversation, sorted by sequence and folded into messages:
``message`` and ``delta`` append to the turn's text, ``edit`` replaces it, and
``regenerate`` discards it for what follows.  Messages are then rendered as

    <|turn|>ROLE<|text|>TEXT<|end|>

Escaping.  Control strings of this and other templates start with ``<`` or
``[`` (``</s>``, ``[INST]``, ``<|end|>``, ``<<SYS>>``).  In roles and texts each
``<``, ``[`` and backslash is followed by an added backslash, which breaks all
of them; every one of the three is so followed, hence reading left to right
and dropping the added backslash gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
REPLACING = ("edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", r"$1")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log with one ``message`` event a row.

    Rows that repeat a turn of a conversation stay messages of their own.
    """
    same = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return conversations.select("conv_id", "turn", F.row_number().over(same).cast("long").alias("part"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text): the final messages of a log.

    The text of a message is that of its last ``edit`` or ``regenerate`` and of
    the events after it; null texts add nothing.  Its role is the last that
    isn't null, else empty.
    """
    part = F.col("part") if "part" in events.columns else F.lit(1).cast("long")
    log = events.select("conv_id", "turn", part.alias("part"), "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    found = log.groupBy("conv_id", "turn", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "text"))).alias("log"), F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"))
    last = F.array_max(F.transform("log", lambda x, i: F.when(x.kind.isin(*REPLACING), i).otherwise(0)))
    text = F.array_join(F.transform(F.slice("log", last + 1, F.size("log")), lambda x: x.text), "")
    return found.select("conv_id", "turn", "part", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask): one string a conversation.

    loss_mask lists the (start, end) code points of formatted that hold the
    trained role's texts: each text between its marks, without the marks.
    """
    piece = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    shown = messages.select("conv_id", F.struct("turn", "part", piece.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained_role).alias("loss")).alias("m"))
    all_of = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def add(acc, m):
        start = acc.at + F.length(m["head"])
        end = start + F.length(m["body"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(END)).cast("long").alias("at"), F.when(m.loss, F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    formatted = F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
    return all_of.select("conv_id", formatted.alias("formatted"), F.aggregate("ms", zero, add)["mask"].alias("loss_mask"))


def format_chats(events: DataFrame) -> DataFrame:
    """render(fold(events)); a null conv_id is a conversation of its own."""
    return render(fold(events))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, masked) from formatted strings and masks alone.

    turns: the (role, text) of each turn.  masked: the text under the mask.
    """
    parts = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != "")
    turn = lambda x: F.struct(unescape(F.substring_index(x, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(x, TEXT, -1), END, 1)).alias("text"))
    masked = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
    return chats.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"), masked.alias("masked"))
