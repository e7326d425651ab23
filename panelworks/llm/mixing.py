"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.llm.staging import WORD, broadcast_if_small, stored

#: The hash of a document has LEVELS x BITS bits; each level's histogram has 2 ** BITS buckets per source.
BITS, LEVELS = 12, 5
WEIGHTS = (1, 2, 3)
MOST = 3


def hash_key(column: str) -> Column:
    """60 bits of the MD5 of the id as text (a null id: of the empty text)."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` with a ``target`` each: shares of the total by weight, none above ``most`` x its size.

    Sources by code point, null last, get the weights in turn. Filling by rising capacity per weight, a source is full
    as long as the level of the rest would exceed its own. The table has one row per source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    weighed = sizes.withColumn("weight", turn).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    total, all_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = all_weight - F.sum("weight").over(upto) + F.col("weight")
    leveled = weighed.withColumn("level", left / rest)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    level = F.coalesce(F.max(fits).over(everything), F.lit(0.0))
    return leveled.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select(
        "source", "source_size", "target"
    )


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """How often each document is taken. Returns one row per input row: ``id, size, source_size, target, taken``.

    Every document is repeated ``floor(target / source_size)`` times; the rest of the budget goes to the documents
    whose hash is below a threshold. Nested histograms find it: words by source and hash bucket, then again inside the
    bucket where the budget ends, until that bucket is one hash value, which is taken if that comes nearer. Nothing is
    sorted by hash, and only the boundary bucket is read again. Repeated rows share a hash and are taken together. A
    null text has size 0 and a null source is a source of its own; empty sources get 0. An empty table gives none.
    """
    sized, final = _thresholds(docs, id_column, text_column, source_column, weights, most)
    taken = F.col("size") * _times(F.col("key"))
    return sized.join(final, sized["source"].eqNullSafe(F.col("of"))).select(
        "id", "size", "source_size", "target", taken.alias("taken")
    )


def _times(key: Column) -> Column:
    extra = (key < F.col("prefix")) | ((key == F.col("prefix")) & F.col("whole"))
    return F.col("repeats") + F.when(extra, 1).otherwise(0)


def _words(text_column: str) -> Column:
    return F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("long")


def _thresholds(
    docs: DataFrame, id_column: str, text_column: str, source_column: str, weights: tuple[int, ...], most: int
) -> tuple[DataFrame, DataFrame]:
    """The sized documents, and per source (``of``) the repeats and the hash threshold."""
    sized = stored(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            _words(text_column).alias("size"),
            hash_key(id_column).alias("key"),
        ),
        "mix-sizes",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = (
        source_targets(sizes, weights, most)
        .withColumn("repeats", repeats.cast("long"))
        .withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
        .select("source", "source_size", "target", "repeats", "budget", F.lit(0).cast("long").alias("prefix"))
    )
    state = stored(state, "mix-state")
    for level in range(LEVELS):
        state = stored(_refine(sized, state, level), f"mix-state{level}")
    return sized, broadcast_if_small(state.withColumnRenamed("source", "of"))


def _refine(sized: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """The state with the prefix of the bucket in which each source's budget ends, one level deeper.

    ``budget`` becomes what is left of it there; ``whole`` (last level) whether that bucket is nearer taken than left.
    """
    shift = BITS * (LEVELS - level - 1)
    known = broadcast_if_small(state.select(F.col("source").alias("of"), "prefix", "budget"))
    inside = F.shiftright("key", shift + BITS) == F.col("prefix")
    bucket = F.shiftright("key", shift)
    sums = (
        sized.join(known, sized["source"].eqNullSafe(F.col("of")) & inside)
        .groupBy("source", bucket.alias("bucket"))
        .agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    )
    running = Window.partitionBy("source").orderBy("bucket")
    ends = (
        sums.withColumn("upto", F.sum("words").over(running))
        .where(F.col("upto") > F.col("budget"))
        .groupBy(F.col("source").alias("of"))
        .agg(F.min(F.struct("bucket", "upto", "words")).alias("end"))
    )
    left = F.col("budget") - (F.col("end.upto") - F.col("end.words"))
    joined = state.drop("whole").join(ends, state["source"].eqNullSafe(F.col("of")), "left")
    return joined.select(
        "source",
        "source_size",
        "target",
        "repeats",
        F.coalesce(left, F.lit(0.0)).alias("budget"),
        F.coalesce("end.bucket", F.lit(0).cast("long")).alias("prefix"),
        F.coalesce((F.col("end.words") - left) < left, F.lit(False)).alias("whole"),
    )


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as it takes to differ from ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def repeat_rows(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    out: str = "times",
) -> DataFrame:
    """``docs`` with how many copies of each row the mix holds (0: none, as for rows without words), in a last column
    named by ``free_name(out)``: a column of ``docs`` with that name stays as it is.

    The thresholds of its source decide each row where it is read, so texts are not shuffled.
    """
    final = _thresholds(docs, id_column, text_column, source_column, weights, most)[1]
    rule = broadcast_if_small(final.select("of", F.struct("repeats", "prefix", "whole").alias("rule")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source_column).alias("from"),
        hash_key(id_column).alias("key"),
        _words(text_column).alias("words"),
    )
    extra = (F.col("key") < F.col("rule.prefix")) | ((F.col("key") == F.col("rule.prefix")) & F.col("rule.whole"))
    times = F.when(F.col("words") > 0, (F.col("rule.repeats") + F.when(extra, 1).otherwise(0)).cast("int")).otherwise(0)
    joined = rows.join(rule, F.col("from").eqNullSafe(F.col("of")), "left")
    return joined.select("row.*", times.alias(free_name(out, docs.columns)))
