"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation becomes one or more windows of whole turns. Prefix sums of turn tokens choose the
window in which a turn is new: the sums are cut into shares of half of what a window has for new turns, the turns that begin in
a share make a window, and a turn longer than a share, which is the last to begin in it, makes one of its own. The system
turn comes back in every window, and the turns just before a window come back as history within a limit. Only assistant texts that are new in their
window are under the loss, so each is learnt from once.

Template, all of it outside the loss: ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` newline. Inside
roles and texts a backslash goes before every backslash and between ``<`` and ``|``, so no text can
hold a control string and the texts can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tokens of a window: system turn, history and new turns; and of its history.
BUDGET, HISTORY = 1024, 192
#: Tokens that the template adds to a turn.
MARKS = 4
# The control strings.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Turns whose prefix sums one task adds up.
_BAND = 512


def turn_tokens(text: Column) -> Column:
    """An estimate of a turn's tokens: four bytes each, and the template's."""
    return (F.ceil(F.octet_length(text) / 4) + MARKS).cast("long")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|(?<=<)\|)", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, formatted, loss, n_repeated, n_turns``: the windows of all conversations (columns conv_id, turn, role, text).

    ``loss`` holds the spans of ``formatted`` (start, end exclusive, in code points) under the loss;
    the first ``n_repeated`` of the ``n_turns`` turns were in an earlier window. Turns are ordered by
    turn, role and text, null turns first; a null role or text counts as empty; repeated rows are
    turns of their own; rows with a null conv_id form a conversation. A first turn of role
    ``system`` is retained in all windows. A turn stays whole: no window is over its budget unless it holds a single
    turn beside the system turn. Other columns are dropped; an empty table gives an empty one.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", turn_tokens(F.col("text"))).withColumn("band", F.floor(F.col("turn") / _BAND))
    # Prefix sums in bands of turns, so that one long conversation is not sorted in one task.
    first = F.min(F.struct("turn", "role", "text", "tokens")).alias("first")
    bands = turns.groupBy("conv_id", "band").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), first)
    before, whole = Window.partitionBy("conv_id").orderBy("band"), Window.partitionBy("conv_id")
    opening = F.min("first").over(whole)
    system = F.when(opening["role"] == "system", opening["tokens"]).otherwise(0)
    bands = bands.withColumn("system", system).drop("first")
    bands = bands.select(
        F.col("conv_id").alias("c"), F.col("band").alias("b"), F.sum("t").over(before).alias("upto"), F.sum("n").over(before).alias("n_upto"), "t", "n",
        F.sum("t").over(whole).alias("whole"), "system",
    )
    within = Window.partitionBy("conv_id", "band").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("upto_turn", F.sum("tokens").over(within)).withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "band").orderBy("turn", "role", "text")))
    placed = placed.join(bands, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("band").eqNullSafe(F.col("b"))).select(
        "conv_id", "role", "text", "tokens", "whole", "system",
        (F.col("upto") - F.col("t") + F.col("upto_turn") - F.col("tokens")).alias("start"),
        (F.col("n_upto") - F.col("n") + F.col("nth")).alias("number"),
    )
    # Turns that begin in one share, each within a share's length, fill at most two shares.
    share = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("system")) / 2))
    window_of = lambda at: 2 * F.floor(at / share)
    retained = (F.col("number") == 1) & (F.col("role") == "system")
    own = F.when(retained, 0).otherwise(window_of(F.col("start")) + (F.col("tokens") > share).cast("int")).cast("int")
    # Windows that may begin within the limit after the turn's beginning; whether they do shows when they are together.
    last = (window_of(F.col("start") + history) + 1).cast("int")
    end = (window_of(F.col("whole") - 1) + 1).cast("int")
    shown = F.when(retained, F.sequence(F.lit(0), end)).otherwise(F.sequence(own, F.least(last, end)))
    placed = placed.withColumn("own", own).select("*", F.explode(shown).alias("window"))
    text = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    piece = F.struct(
        "number",
        (F.col("window") > F.col("own")).alias("repeated"),
        text.alias("head"),
        escaped(F.col("text")).alias("body"),
        ((F.col("window") == F.col("own")) & (F.col("role") == "assistant")).alias("learnt"),
        "start",
        "tokens",
        retained.alias("retained"),
    )
    grouped = placed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("turns"), F.any_value("system").alias("system"))
    # A window whose share of tokens lies inside one long turn has no new turn: it isn't written.
    grouped = grouped.filter(F.exists("turns", lambda t: ~t["repeated"]))
    new = F.filter("turns", lambda t: ~t["repeated"])
    room = budget - F.aggregate(new, F.lit(0).cast("long"), lambda n, t: n + t["tokens"]) - F.when(new[0]["retained"], 0).otherwise(F.col("system"))
    grouped = grouped.withColumns({"begin": new[0]["start"], "room": F.least(F.lit(history), room)})
    kept = F.filter("turns", lambda t: ~t["repeated"] | t["retained"] | (F.col("begin") - t["start"] <= F.col("room")))
    grouped = grouped.withColumn("turns", kept)
    size = lambda t: F.char_length(t["head"]) + F.char_length(t["body"]) + len(END)
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), nothing.alias("spans"))
    start = lambda acc, t: acc["at"] + F.char_length(t["head"])
    walked = F.aggregate(
        "turns", zero,
        lambda acc, t: F.struct(
            (acc["at"] + size(t)).cast("bigint").alias("at"),
            F.when(t["learnt"], F.concat(acc["spans"], F.array(F.struct(start(acc, t).cast("bigint").alias("start"), (start(acc, t) + F.char_length(t["body"])).cast("bigint").alias("end")))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return grouped.select(
        "conv_id", "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        walked["spans"].alias("loss"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.size("turns").alias("n_turns"),
    )


def read_back(written: DataFrame) -> DataFrame:
    """``conv_id, window, turns, learnt``: the new turns (role, text) of each window and its texts under the loss, from the written strings alone."""
    raw = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != "")
    parts = F.transform(raw, lambda x: F.split(x, r"<\|text\|>", 2))
    turns = F.transform(parts, lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(F.substring(x[1], F.lit(1), F.char_length(x[1]) - len(END))).alias("text")))
    learnt = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return written.select("conv_id", "window", F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.size(turns) - F.col("n_repeated"), F.lit(0))).alias("turns"), learnt.alias("learnt"), F.char_length("formatted").cast("long").alias("chars"))


def digests(written: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The digests are of whole conversations, so each conversation meets in one row here, and only here.
    """
    per = read_back(written).select(
        "conv_id",
        F.struct(
            "window", F.size("turns").cast("long").alias("n"), "chars",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("told"),
            F.array_join("learnt", "").alias("learnt"),
        ).alias("w"),
    )
    whole = per.groupBy("conv_id").agg(F.sum("w.n").alias("n_turns"), F.sum("w.chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("w.window", "w.told", "w.learnt"))).alias("w"))
    told, learnt = F.array_join(F.col("w.told"), ""), F.array_join(F.col("w.learnt"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(told, 256).alias("turns_sha256"), F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars",
    )
