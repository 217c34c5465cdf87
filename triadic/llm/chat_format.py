"""Chat formatting, by event-sourced reconstruction. DataFrame functions only.

A log holds events of conversations: whole messages, streamed deltas, edits and
regenerations. Events are partitioned by conversation, put in sequence order and
folded into final messages, which are then rendered with a loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Control strings of the template: fixed values.
START = "<|im_start|>"
END = "<|im_end|>"
NEWLINE = "<|nl|>"  # a line break inside a role


def escape(c: Column) -> Column:
    """No ``<|`` is left: ``<``, k backslashes, ``|`` becomes the same with k + 1."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(NEWLINE), F.lit("\n")))


def turns_as_events(rows: DataFrame) -> DataFrame:
    """A table with one row a turn as a log of whole messages.

    Null role or text: empty. Null turn: before all others. Rows that share a
    conversation and turn stay separate messages, ordered by role, then text.
    """
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    one = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")  # the one shuffle: all later groups are within a conversation
    return one.withColumn("_k", F.row_number().over(w)).select(
        "conv_id", F.struct(F.col("turn").alias("major"), F.col("_k").alias("minor")).alias("message"),
        F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text",
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: (conv_id, message, role, text).

    events: conv_id, message (any orderable id, rising in the conversation), seq
    (order of the events of a message), kind, role, text. ``message`` and
    ``regenerate`` start the text anew, ``delta`` appends to what stands,
    ``edit`` replaces it, ``delete`` removes the message unless a later event
    starts it anew. Null kind: message; null text: empty; unknown kinds do
    nothing. The role is the last that is not null, else empty. Events with the
    same seq apply in the order of kind, then text; an event repeated in every
    column counts once (logs are delivered at least once), except in a table of
    turns, where each row has its own message id.

    Only what follows the last restart is gathered, so a long history of
    regenerations costs no memory in the fold.
    """
    e = events.select(
        "conv_id", "message", F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"),
        "role", F.coalesce("text", F.lit("")).alias("text"),
    ).dropDuplicates()
    restart = F.col("kind").isin("message", "regenerate", "edit", "delete")
    order = F.struct("seq", "kind", "text")
    by = Window.partitionBy("conv_id", "message")
    e = e.withColumn("_o", order).withColumn("_last", F.max(F.when(restart, F.col("_o"))).over(by))
    parts = F.array_sort(F.collect_list(F.when((F.col("_last").isNull() | (F.col("_o") >= F.col("_last"))) & F.col("kind").isin("message", "regenerate", "edit", "delta"), F.col("_o"))))
    return (
        e.groupBy("conv_id", "message")
        .agg(
            F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"),
            F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("_o"))), F.lit("")).alias("role"),
            F.size(parts).alias("_n"),
        )
        .where("_n > 0")
        .select("conv_id", "message", "role", "text")
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, formatted, mask (spans in code points, end exclusive).

    messages: conv_id, message, role, text, without nulls in role and text. The
    mask holds one span for each message of a role in ``loss_roles``, empty texts
    included. A conversation's text is one value, so its messages meet in one
    task by definition; nothing else does.
    """
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    r = messages.select(
        "conv_id", "message", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("body"),
        F.col("role").isin(*loss_roles).alias("loss"),
    )
    tail = F.lit(END + "\n")
    w = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("head") + F.length("body") + len(END) + 1
    r = r.withColumn("_end", F.sum(size).over(w) - (len(END) + 1))
    parts = F.array_sort(F.collect_list(F.struct("message", F.concat("head", "body", tail).alias("s"), "loss", (F.col("_end") - F.length("body")).alias("start"), F.col("_end").alias("end"))))
    g = r.groupBy("conv_id").agg(parts.alias("p"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("mask"),
    )


def parse(formatted: Column) -> Column:
    """Back from the text: array of (role, text)."""
    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    blocks = F.slice(blocks, F.lit(2), F.size(blocks) - 1)

    def one(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        # after the head's line break, up to the end mark and its line break
        body = F.substr(b, F.length(head) + 2, F.length(b) - F.length(head) - 2 - len(END))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(blocks, one)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


def digest(rendered: DataFrame) -> DataFrame:
    """What a reader gets back from formatted conversations, as counts and digests."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    d = rendered.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    return d.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(events: DataFrame) -> DataFrame:
    return render(fold_events(events))
