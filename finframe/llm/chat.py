"""Conversations formatted into token-budgeted windows, with a loss mask.

Prefix sums of turn tokens place every turn on a line; the line is cut into
cells of half the room that a window has for new turns.  The turns that start in
a cell form a span, and a turn longer than a cell is a span of its own.  Only the
last turn of a cell can reach over its end, and by no more than a cell, so a span
never exceeds the room, unless one turn alone does.  A window is the
conversation's system turn, a limited number of turns from the span before, and
the span.  Assistant texts of the span bear the loss; what is repeated does not.

No conversation is gathered: prefix sums run over sorted ranges, spans meet the
turns before them by their position, and a window holds two spans at most.

Template: ``<s>`` then for each turn ``<|turn|>role\\ntext<|end|>``.  Inside
texts a control string gets a backslash after its first character (one more, if
there are some already), which ``unescaped`` takes back.

Defined results: turns are ordered by turn (null last), role, text; null texts
and roles are empty; rows with a null id are one conversation of their own; repeated
rows are turns of their own; only a first turn of role ``system`` is retained;
an empty table gives no rows; columns other than the four named are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finframe.operators.ordering import positioned

BUDGET = 1024  # tokens of a window
HISTORY_TURNS = 2
HISTORY_TOKENS = 192
MARK_TOKENS = 4  # the template's own tokens of a turn

BEGIN, TURN, END = "<s>", "<|turn|>", "<|end|>"
#: What follows the first character of a control string, this template's and the common ones; it holds no such character.
CONTROL = r"(?:\|[a-z_]+\|>|/?s>|/?INST\]|/?SYS>>)"
WORD_OR_SIGN = r"[\p{L}]+|\p{N}|[^\s\p{L}\p{N}]+"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)(?=" + CONTROL + ")", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)\\(?=" + CONTROL + ")", "$1")


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _plain_role(role: Column) -> Column:
    held = F.replace(F.replace(F.replace(role, F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))
    return unescaped(held)


def tokens_of(text: Column) -> Column:
    """Words, digits and runs of signs, and the template's marks."""
    return (F.regexp_count(text, F.lit(WORD_OR_SIGN)) + MARK_TOKENS).cast("long")


def _placed(turns: DataFrame, order: list[Column]) -> DataFrame:
    """Turns with ``_from`` and ``_to``, their tokens' place in the conversation; no conversation is one task's."""
    rows = positioned(turns, order, ["_conv"], copies=True)
    inside = Window.partitionBy("_conv", "_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.sum("_tokens").over(inside))
    sums = rows.groupBy("_conv", "_pid").agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy("_conv").orderBy("_pid")  # one row per range that the conversation touches
    sums = sums.select("_conv", "_pid", (F.sum("_sum").over(before) - F.col("_sum")).alias("_base"))
    rows = rows.join(sums, ["_conv", "_pid"]).withColumn("_to", F.col("_to") + F.col("_base"))
    return rows.withColumn("_from", F.col("_to") - F.col("_tokens")).drop("_base", "_pos", "_pid")


def windows(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """``<id_col>, start, n_repeated, n_fresh, tokens, text, loss``: one row per window.

    ``start`` orders the windows of a conversation; ``loss`` holds the code
    points (start, end) of ``text`` that bear the loss.
    """
    empty = F.lit("")
    known = turns.select(
        F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), empty).alias("_conv"),
        F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), empty).alias("_role"), F.coalesce(F.col(text_col), empty).alias("_text"),
    ).withColumn("_tokens", tokens_of(F.col("_text")))
    rows = _placed(known, [F.asc_nulls_last("_turn"), F.col("_role"), F.col("_text")])
    system = rows.where((F.col("_from") == 0) & (F.col("_role") == "system")).select(
        "_conv", F.col("_text").alias("_sys"), F.col("_tokens").alias("_sys_tokens"))
    rows = rows.join(system.select("_conv", "_sys_tokens"), "_conv", "left")
    room = F.lit(budget - history_tokens) - F.least(F.coalesce("_sys_tokens", F.lit(0)), F.lit(budget // 2))
    rows = rows.withColumn("_cell", F.greatest(F.lit(1), F.floor(room / 2)).cast("long")).drop("_sys_tokens")
    rows = rows.withColumn("_span", 2 * F.floor(F.col("_from") / F.col("_cell")) + (F.col("_tokens") > F.col("_cell")).cast("long"))
    ends = rows.groupBy("_conv", "_span").agg(F.min("_from").alias("_start"), F.max("_to").alias("_end"))
    rows = rows.join(ends, ["_conv", "_span"])
    # a turn is new in the window that starts with its span and may be repeated in the one that starts at its end
    late = F.col("_end") - F.col("_from") <= history_tokens
    first = (F.col("_from") == 0) & (F.col("_role") == "system")
    uses = F.array(F.struct(F.col("_start").alias("start"), F.lit(True).alias("fresh")), F.when(late & ~first, F.struct(F.col("_end").alias("start"), F.lit(False).alias("fresh"))))
    used = rows.withColumn("_use", F.explode(F.filter(uses, lambda u: u.isNotNull())))
    turn = F.struct(F.col("_from").alias("at"), F.col("_use.fresh").alias("fresh"), F.col("_role").alias("role"), F.col("_text").alias("text"), F.col("_tokens").alias("tokens"))
    found = used.groupBy("_conv", F.col("_use.start").alias("start")).agg(F.first("_id", ignorenulls=True).alias(id_col), F.array_sort(F.collect_list(turn)).alias("_turns"))
    found = found.withColumns({"_fresh": F.filter("_turns", lambda t: t["fresh"]), "_old": F.filter("_turns", lambda t: ~t["fresh"])}).where(F.size("_fresh") > 0)
    found = found.join(system, "_conv", "left")
    keep = F.least(F.size("_old"), F.lit(history_turns))
    head = F.when((F.col("start") > 0) & F.col("_sys").isNotNull(), F.array(F.struct(
        F.lit(-1).cast("long").alias("at"), F.lit(False).alias("fresh"), F.lit("system").alias("role"), F.col("_sys").alias("text"), F.col("_sys_tokens").alias("tokens"))))
    old = F.slice("_old", F.size("_old") - keep + 1, keep)
    found = found.withColumn("_all", F.concat(F.coalesce(head, F.slice("_old", 1, 0)), old, F.col("_fresh")))
    shown = F.transform("_all", lambda t: F.struct(
        t["fresh"].alias("fresh"), t["role"].alias("role"), t["tokens"].alias("tokens"),
        F.concat(F.lit(TURN), _escaped_role(t["role"]), F.lit("\n")).alias("lead"), escaped(t["text"]).alias("body")))
    found = found.withColumn("_shown", shown).drop("_all", "_turns", "_old", "_sys", "_sys_tokens")
    begin = F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss"))

    def step(done: Column, t: Column) -> Column:
        start = done["at"] + F.length(t["lead"])
        end = start + F.length(t["body"])
        bears = t["fresh"] & (t["role"] == "assistant")
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(bears, F.concat(done["loss"], span)).otherwise(done["loss"]).alias("loss"))

    return found.select(
        id_col, "start", (F.size("_shown") - F.size("_fresh")).alias("n_repeated"), F.size("_fresh").alias("n_fresh"),
        F.aggregate("_shown", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"),
        F.concat(F.lit(BEGIN), F.array_join(F.transform("_shown", lambda t: F.concat(t["lead"], t["body"], F.lit(END))), "")).alias("text"),
        F.aggregate("_shown", begin, step, lambda done: done["loss"]).alias("loss"),
    )


def read_back(text: Column, n_repeated: Column) -> Column:
    """The new turns (role, text) of a window, parsed from its text."""
    parts = F.split(text, r"<\|turn\|>", -1)
    fresh = F.slice(parts, n_repeated + 2, F.greatest(F.size(parts) - 1 - n_repeated, F.lit(0)))
    return F.transform(fresh, lambda p: F.struct(
        _plain_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))).alias("text")))


def under_loss(text: Column, loss: Column) -> Column:
    """All text under the mask of a window, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
