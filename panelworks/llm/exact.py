"""Exact duplicates: two Bloom passes find the hashes that may repeat, only their rows are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelworks.llm.staging import SPACE, broadcast_if_small, stored

#: Bits of each of the two filters. A filter is at most SLOTS / 8 bytes (8 MiB), whatever the input; where the rows
#: outgrow it, more rows take the exact way, and the result stays the same.
SLOTS = 1 << 26


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _slot(digest: Column, seed: int, slots: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(slots)) + 1


def _repeated_bits(digests: DataFrame, seed: int, slots: int) -> DataFrame:
    """The slots that two rows or more fall into, as rows of 32,768 bits each."""
    hit = digests.groupBy(_slot(F.col("sha"), seed, slots).alias("slot")).agg(F.count("*").alias("n")).where("n > 1")
    bits = hit.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    return stored(bits, f"exact-bits{seed}")


def _probe(frame: DataFrame, bits: DataFrame, seed: int, slots: int) -> DataFrame:
    """Adds ``_hit{seed}``: whether the row's slot is set in ``bits``. The broadcast is bounded by SLOTS."""
    slot = _slot(F.col("sha"), seed, slots)
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = frame.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("part"), "left")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return joined.select(*[frame[c] for c in frame.columns], hit.alias(f"_hit{seed}"))


def _suspects(frame: DataFrame, filters: list[DataFrame], slots: int) -> DataFrame:
    for seed, bits in enumerate(filters):
        frame = _probe(frame, bits, seed, slots)
    hits = [f"_hit{seed}" for seed in range(len(filters))]
    return frame.withColumn("_suspect", F.expr(" AND ".join(hits))).drop(*hits)


def _digests(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column)
    return stored(
        docs.select(
            F.col(id_column).alias("id"),
            F.sha2(normalised(text), 256).alias("sha"),
            F.coalesce(F.length(text), F.lit(0)).alias("n"),
        ),
        "exact-digests",
    )


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", slots: int = SLOTS
) -> DataFrame:
    """Which row of each group of equal texts stays. Texts are equal when they are so without ASCII white space.

    Returns one row per input row: ``id, sha, keep_id, group_size, kept``. The longest original text stays, then the
    smallest id; a null id comes after all others. A null text is an empty one, and all empty texts are one group. Of
    rows that repeat id and text, one stays. An empty table gives an empty result; other columns are not looked at.

    First pass: count rows by hash slot, twice with independent hashes, and keep the slots hit more than once as
    bitmaps. Second pass: a row whose two slots are both set is suspected and grouped by its full SHA-256; all others
    pass through unshuffled. Groups are aggregated before the shuffle, and the join back is one that adaptive
    execution can split, so a group may hold any share of the rows.
    """
    digests = _digests(docs, id_column, text_column)
    filters = [_repeated_bits(digests, seed, slots) for seed in range(2)]
    marked = _suspects(digests, filters, slots)
    single = marked.where("NOT _suspect").select(
        "id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    suspects = marked.where("_suspect").drop("_suspect")
    order = F.struct(F.col("n"), F.col("id").isNotNull(), F.bitwise_not(F.col("id").cast("long")))
    groups = stored(
        suspects.groupBy("sha").agg(
            F.max_by("id", order).alias("keep_id"), F.max("n").alias("longest"), F.count("*").alias("group_size")
        ),
        "exact-groups",
    )
    first = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("longest"))
    matched = suspects.join(groups, "sha").withColumn("first", first)
    last = matched.where("NOT first").withColumn("kept", F.lit(False))
    copies = matched.where("first").groupBy("id", "sha", "keep_id", "group_size").agg(F.count("*").alias("copies"))
    repeated = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    stays = repeated.withColumn("kept", F.col("copy") == 1)
    columns = ["id", "sha", "keep_id", "group_size", "kept"]
    return single.unionByName(last.select(columns)).unionByName(stays.select(columns))


def drop_exact_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", slots: int = SLOTS
) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns. Only suspected rows are shuffled."""
    digests = _digests(docs, id_column, text_column)
    filters = [_repeated_bits(digests, seed, slots) for seed in range(2)]
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.sha2(normalised(F.col(text_column)), 256).alias("sha"),
        F.coalesce(F.length(text_column), F.lit(0)).alias("n"),
        row,
    )
    marked = _suspects(rows, filters, slots)
    order = F.struct(F.col("n"), F.col("id").isNotNull(), F.bitwise_not(F.col("id").cast("long")))
    keepers = stored(
        _suspects(digests, filters, slots)
        .where("_suspect")
        .groupBy("sha")
        .agg(F.max_by("id", order).alias("keep_id"), F.max("n").alias("longest")),
        "exact-keepers",
    )
    on = [rows["sha"] == keepers["sha"], rows["id"].eqNullSafe(keepers["keep_id"]), rows["n"] == keepers["longest"]]
    stays = marked.where("_suspect").join(broadcast_if_small(keepers, 100_000), on, "left_semi").dropDuplicates(["sha", "id"])
    return marked.where("NOT _suspect").select("row.*").unionByName(stays.select("row.*"))
