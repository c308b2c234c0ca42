"""Chat formatting from an event log, with DataFrame functions only.

A log holds events of conversations: ``delta`` appends its text to a message (the first
one opens it), ``edit`` replaces the message's text so far, ``regenerate`` throws away the
message's text so far together with all later messages begun before it. The log is
partitioned by conversation once; within that partitioning events are folded per message,
messages are ordered, and the conversation is rendered, so nothing is shuffled again. The
unit of work is one conversation, because its rendered text is one value of the result.

Template: ``<|im_start|>role`` newline text ``<|im_end|>`` newline. Inside roles and texts
``<|`` is escaped by a backslash between the two characters (one more where backslashes
stand there already), so no text can contain a control string and nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log.

    *log* has conv_id, seq, message (the message's ordinal), kind, role, text. Events are
    taken by (seq, kind, text); an event of unknown or null kind counts as a delta, null
    text and role as empty. A message without surviving event does not appear; the role is
    the last one stated. A null conv_id is a conversation of its own.
    """
    kind = F.coalesce("kind", F.lit("delta"))
    events = log.select(
        "conv_id", "message", F.struct(F.col("seq"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role")).alias("e")
    )
    events = events.withColumn("again", F.when(kind_is("regenerate"), F.col("e.seq"))).withColumn("reset", F.when(kind_is("edit", "regenerate"), F.col("e.seq")))
    per = events.repartition("conv_id").groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("e")).alias("es"), F.max("again").alias("again"), F.max("reset").alias("reset"))
    order = Window.partitionBy("conv_id").orderBy("message")
    since = F.greatest(F.max("again").over(order), F.col("reset"))
    kept = F.filter("es", lambda e: F.col("since").isNull() | (e["seq"] >= F.col("since")))
    roles = F.filter(F.transform("es", lambda e: e["role"]), lambda r: r.isNotNull())
    return (
        per.withColumn("since", since)
        .withColumn("roles", roles)
        .withColumn("es", kept)
        .filter(F.size("es") > 0)
        .select(
            "conv_id",
            "message",
            F.coalesce(F.get("roles", F.size("roles") - 1), F.lit("")).alias("role"),
            F.array_join(F.transform("es", lambda e: e["text"]), "").alias("text"),
        )
    )


def kind_is(*names: str) -> Column:
    return F.col("e.kind").isin(*names)


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` and ``spans``.

    ``spans`` has one entry per turn: start and length (code points) of its escaped text
    in ``formatted``, and ``loss``, true for assistant turns.
    """
    role = F.regexp_replace(escaped(F.col("role")), "\n", "<|nl|>")
    text = escaped(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turn = F.concat(head, text, F.lit(END))
    order = Window.partitionBy("conv_id").orderBy("message")
    before = F.coalesce(F.sum(F.length("turn")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct(
        (before + F.col("head_chars")).cast("long").alias("start"),
        F.col("text_chars").cast("long").alias("length"),
        (F.col("role") == "assistant").alias("loss"),
    )
    turns = messages.select("conv_id", "message", "role", turn.alias("turn"), F.length(head).alias("head_chars"), F.length(text).alias("text_chars"))
    turns = turns.select("conv_id", F.struct("message", "turn", span.alias("span")).alias("t"))
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("ts"))
        .select("conv_id", F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("formatted"), F.transform("ts", lambda t: t["span"]).alias("spans"))
    )


def parse(formatted: Column) -> Column:
    """The turns read back from a formatted text: array of (role, text), unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(START) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.lit(2**31 - 1))
        return F.struct(unescaped(F.replace(role, F.lit("<|nl|>"), F.lit("\n"))).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def format_chats(log: DataFrame) -> DataFrame:
    """Fold an event log and render every conversation.

    An empty log gives no rows; columns other than the log's own are not read, so their
    names cannot clash. Native expressions throughout.
    """
    return render(fold_events(log))
