"""Conversations as training windows within a token budget, with a loss mask, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.llm.staging import WORD

#: Fixed values of the template: a turn is ROLE role TEXT text END.
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: What opens or closes a turn in this or another common template; inside texts a backslash is put into each.
_CONTROL_HEAD = r"(<|\[)"
_CONTROL_TAIL = r"(\||/?s>|/?INST\]|/?SYS)"
#: New tokens of a window, tokens of repeated history, and tokens that the template adds to a turn.
BUDGET, HISTORY, OVERHEAD = 1024, 256, 4


def escape(text: Column) -> Column:
    """Put one more backslash behind the first character of each control string: none is left, and it is reversible."""
    return F.regexp_replace(text, _CONTROL_HEAD + r"(\\*)" + _CONTROL_TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL_HEAD + r"\\(\\*)" + _CONTROL_TAIL, "$1$2$3")


def chat_windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per window: ``conv_id, window, formatted, repeated, loss``.

    The prefix sum of a conversation's turn tokens (words plus the template's) divided by ``budget`` numbers the
    windows, so each holds whole turns and at most ``budget`` new tokens beside its last turn. A window begins with the
    system turns that stand at the beginning, then the turns that started within ``history`` tokens before its first
    new turn; these ``repeated`` turns come first and are masked. ``loss`` holds begin and length, in code points, of
    the text of each new assistant turn.

    A null text or role is an empty one. Turns are ordered by turn (null first), ties by role and text; repeated rows
    are repeated turns. A null conversation id is a conversation. Other columns are not looked at. An empty table gives
    no rows; every turn of any length is kept whole.
    """
    if history > budget:
        raise ValueError("history must not exceed the budget")
    rows = turns.select(
        F.col(conv_column).alias("conv_id"),
        F.col(turn_column).alias("turn"),
        F.coalesce(role_column, F.lit("")).alias("role"),
        F.coalesce(text_column, F.lit("")).alias("text"),
    )
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    back = Window.partitionBy("conv_id").orderBy(F.desc("at"))
    tokens = (F.regexp_count("text", F.lit(WORD)) + OVERHEAD).cast("long")
    placed = (
        rows.withColumn("tokens", tokens)
        .withColumn("at", F.row_number().over(by_turn))
        .withColumn("start", F.sum("tokens").over(by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
        .withColumn("others", F.sum(F.when(F.col("role") == "system", 0).otherwise(1)).over(by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("window", F.floor(F.col("start") / budget))
        .withColumn("opens", F.coalesce(F.lag("window").over(by_turn), F.lit(-1)) != F.col("window"))
    )
    # Of each later window: its first start, seen from the turns before it.
    opening = F.when(F.col("opens"), F.struct("window", "start"))
    following = F.last(opening, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    seen = placed.withColumn("next", following)
    repeats = F.when(
        (F.col("others") > 0) & (F.col("start") >= F.col("next.start") - history), F.array(F.col("next.window"))
    ).otherwise(F.array().cast("array<bigint>"))
    piece = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END))
    pieces = seen.select(
        "conv_id",
        "window",
        "at",
        "others",
        repeats.alias("repeats"),
        (F.col("role") == "assistant").alias("learned"),
        (F.length(F.lit(ROLE + TEXT)) + F.length(escape(F.col("role")))).alias("head"),
        F.length(escape(F.col("text"))).alias("body"),
        piece.alias("piece"),
    )
    copies = pieces.select("*", F.explode(F.concat(F.array("window"), "repeats")).alias("into"))
    member = F.struct("at", (F.col("into") == F.col("window")).alias("new"), "learned", "head", "body", "piece")
    grouped = copies.groupBy("conv_id", F.col("into").alias("window")).agg(F.array_sort(F.collect_list(member)).alias("turns"))
    leading = pieces.where("others = 0").groupBy(F.col("conv_id").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("at", F.lit(False).alias("new"), "learned", "head", "body", "piece"))).alias("system"),
        F.max("window").alias("system_until"),
    )
    joined = grouped.join(leading, grouped["conv_id"].eqNullSafe(leading["of"]), "left")
    first = F.expr("turns[0].at")
    missing = F.filter(F.coalesce("system", F.array().cast(grouped.schema["turns"].dataType)), lambda t: t["at"] < first)
    whole = joined.select("conv_id", "window", F.concat(missing, "turns").alias("turns"))
    return whole.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: ~t["new"])).alias("repeated"),
        _loss("turns").alias("loss"),
    )


def _loss(turns: str) -> Column:
    """Begin (1-based) and length of each learned text, from running lengths of the pieces."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<begin:int,length:int>>").alias("spans"))

    def step(acc, t):
        span = F.array(F.struct((acc["at"] + t["head"]).alias("begin"), t["body"].alias("length")))
        spans = F.when(t["new"] & t["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(t["piece"])).alias("at"), spans.alias("spans"))

    return F.aggregate(F.col(turns), start, step, lambda acc: acc["spans"])


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say, per conversation: turns and masked text read from the formatted strings alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Repeated turns are skipped by count.
    The digest is over a conversation's whole text, so one conversation is put together in one row at the end.
    """
    parts = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    fresh = F.expr("slice(parts, repeated + 1, size(parts))")
    said = F.transform(
        fresh,
        lambda p: F.concat(
            unescape(F.substring_index(F.substring(p, len(ROLE) + 1, 1 << 30), TEXT, 1)),
            F.lit("\n"),
            unescape(F.substring_index(p, TEXT, -1)),
            F.lit("\n"),
        ),
    )
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["begin"], s["length"])))
    decoded = windows.withColumn("parts", parts).select(
        "conv_id",
        "window",
        F.size(fresh).alias("n"),
        F.array_join(said, "").alias("said"),
        F.array_join(learned, "").alias("learned"),
        F.length("formatted").alias("chars"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("window", "said", "learned")))
    whole = decoded.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), ordered.alias("w"), F.sum("chars").alias("formatted_chars")
    )
    said_all = F.array_join(F.transform("w", lambda x: x["said"]), "")
    learned_all = F.array_join(F.transform("w", lambda x: x["learned"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(said_all, 256).alias("turns_sha256"),
        F.length(learned_all).cast("long").alias("loss_chars"),
        F.sha2(learned_all, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
