"""Chat logs to training text: events are folded into final messages, then rendered. DataFrame functions only.

Template, per message: ``### role: text</turn>`` and a line feed. Inside texts and roles a backslash is doubled,
``</turn>`` is broken by a backslash and so are any two ``#`` side by side, so that runs of any length hold no ``###``; all
of it is undone exactly by ``unescape``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>"
# Control string -> how it looks inside a text. A backslash in a text is doubled first, so the right sides are new.
BROKEN = {END: "<\\/turn>", "##": "#\\#"}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    # Twice: a run of # is taken two by two, and what is left between the pairs in the second turn.
    for plain, broken in [*BROKEN.items()] * 2:
        out = F.replace(out, F.lit(plain), F.lit(broken))
    return out


def unescape(text: Column) -> Column:
    for plain, broken in [*BROKEN.items()] * 2:
        text = F.replace(text, F.lit(broken), F.lit(plain))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As a text; and ``: ``, which ends the role, is broken too."""
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(":\\ "), F.lit(": ")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, place, role, text) of a log (conv_id, seq, kind, message, role, text).

    Kinds: ``message`` sets the text, ``delta`` appends to it, ``edit`` replaces it, ``regenerate`` empties it so that
    the deltas after it build it anew; null is ``message``, any other kind appends nothing. Messages stand in the
    order of their first event; the role is that of the first event that names one. Events with equal ``seq`` are
    ordered by kind, role and text; null texts are empty. An event without a message id is a message of its own, and
    equal ones are as many messages. A message's events meet in one row, whatever the size of its conversation.
    """
    kind = F.coalesce("kind", F.lit("message"))
    text = F.coalesce("text", F.lit(""))
    event = F.struct(F.col("seq"), kind.alias("kind"), F.col("role"), text.alias("text"))
    # Equal events without an id meet under one key, which a retried task finds again; a row number would not be.
    own = F.when(F.col("message").isNull(), F.struct(F.col("seq"), kind.alias("kind"), F.col("role"), F.sha2(text, 256).alias("text")))
    per = events.select("conv_id", "message", own.alias("own"), event.alias("e")).groupBy("conv_id", "message", "own").agg(
        F.sort_array(F.collect_list("e")).alias("log"), F.min("e.seq").alias("place"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin("message", "edit", "regenerate"), i).otherwise(-1))
    live = F.filter("log", lambda e, i: (i >= F.col("since")) & e["kind"].isin("message", "edit", "delta"))
    copies = F.when(F.col("message").isNull(), F.size("log")).otherwise(1)
    # Of equal events one is folded.
    since = F.when(F.col("message").isNull(), F.size("log") - 1).otherwise(F.array_max(resets))
    return per.withColumn("since", since).select(
        "conv_id", "place", "message",
        F.element_at(F.concat(F.filter(F.col("log")["role"], lambda r: r.isNotNull()), F.array(F.lit(""))), 1).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
        F.explode(F.sequence(F.lit(1), copies))).drop("col")


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask): one row per conversation; mask lists start and length in code points of the
    trained role's texts in ``formatted``. Messages are ordered by place, ties by message, role and text."""
    head = F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(": "))
    parts = messages.select(
        "conv_id", F.struct("place", "message", "role", "text", head.alias("head"), escape(F.col("text")).alias("body")).alias("m"))
    rows = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    size = F.transform("m", lambda m: F.length(m["head"]) + F.length(m["body"]) + len(END) + 1)
    # Where each message starts: running sums, built once.
    start = F.aggregate(
        "size", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
        lambda s: s["all"])
    rows = rows.withColumn("size", size).withColumn("start", start)
    spans = F.transform("m", lambda m, i: F.struct(
        (F.element_at("start", i + 1) + F.length(m["head"])).alias("start"), F.length(m["body"]).cast("long").alias("length"),
        m["role"].alias("role")))
    text = F.array_join(F.transform("m", lambda m: F.concat(m["head"], m["body"], F.lit(END + "\n"))), "")
    mask = F.transform(F.filter(spans, lambda s: s["role"] == trained_role), lambda s: F.struct(s["start"], s["length"]))
    return rows.select("conv_id", text.alias("formatted"), mask.alias("mask"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    turns = F.filter(F.split(formatted, END + "\n"), lambda t: t != "")
    return F.transform(turns, lambda t: F.struct(
        unescape_role(F.substring_index(F.substr(t, F.lit(5)), ": ", 1)).alias("role"),
        unescape(F.substr(t, F.lit(7) + F.length(F.substring_index(F.substr(t, F.lit(5)), ": ", 1)))).alias("text")))


def masked(formatted: Column, mask: Column) -> Column:
    """array<string>: the texts under the mask, as they were before escaping."""
    return F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """Rendered conversations of a table (conv_id, turn, role, text); every row is an event of its own message.

    Rows with equal turn are ordered by role and text and all stay; a null turn sorts first; null roles and texts are
    empty. Rows with a null conv_id form one conversation. Other columns are not read.
    """
    events = turns.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("message"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return render(fold_events(events))
