"""Near duplicates by Jaccard similarity of word shingles: R-trees over count vectors behind a rarest-first routing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from panelworks.llm.bits import collect_bits, holds
from panelworks.llm.components import components
from panelworks.llm.rtree import CountTree, needed
from panelworks.llm.staging import bound_batches, broadcast_if_small, id_or_null, known_id, stored
from panelworks.llm.words import fold, group_edges, hashes, runs, scramble, slices, whole_groups, words

#: Coordinates of a count vector.
GROUPS = 32
#: Slots of the shingle histogram: 4 MiB of counts, whatever the input. It only orders shingles, so any size is exact.
SLOTS = 1 << 20
_PARTS = 16
#: Partners that one group of verification takes; an id with more has several groups.
PARTNERS = 1_000
#: Points of one R-tree; a larger bucket is searched block by block.
BLOCK = 1024
#: A bucket of so few points is one leaf, scanned without a tree.
LEAF = 16
#: Ids that a scan is filtered by in memory (8 bytes each); more are joined.
IDS = 1_000_000


def _sets(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice: first row, distinct shingle hashes by text, and the limits of each text in these."""
    for first, raw, offsets in slices(column):
        data, n = fold(raw), len(offsets) - 1
        begins, ends, owner = words(data, offsets)
        hashed = hashes(data, begins, ends)
        at, shingles = runs(hashed, owner, length)
        text = owner[at]
        # Texts of fewer words: the whole sequence is one shingle.
        count = np.bincount(owner, minlength=n)
        limits = np.concatenate(([0], np.cumsum(count)))
        short = np.flatnonzero((count > 0) & (count < length))
        for size in range(1, length):
            mine = short[count[short] == size]
            if len(mine):
                begin, whole = runs(hashed, owner, size)
                first_of = np.isin(begin, limits[mine])
                text, shingles = np.concatenate((text, owner[begin[first_of]])), np.concatenate((shingles, whole[first_of]))
        order = np.lexsort((shingles, text))
        text, shingles = text[order], shingles[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])
        text, shingles = text[new], shingles[new]
        yield first, shingles, np.searchsorted(text, np.arange(n + 1))


def _histogram(texts: DataFrame, length: int) -> np.ndarray:
    """Documents per hash slot of their shingles, over all documents; summed in parts, SLOTS numbers in the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for _, shingles, _ in _sets(batch.column(0), length):
                np.add.at(total, (shingles % np.uint64(SLOTS)).astype(np.int64), np.uint32(1))
        parts = [part.tobytes() for part in total.reshape(_PARTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                known = sums.setdefault(part, np.zeros(SLOTS // _PARTS, np.int64))
                known += np.frombuffer(counts.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "counts"]
        )

    schema = "part int, counts binary"
    rows = texts.mapInArrow(count, schema).repartition(_PARTS, "part").mapInArrow(add, schema).collect()
    total = np.zeros((_PARTS, SLOTS // _PARTS), np.int64)
    for row in rows:
        total[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(total.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def _prefixes(rows: DataFrame, length: int, percent: int) -> DataFrame:
    """Stored ``id, n, sig, sig2, vector, keys`` of each text: its set's size, two sums that name the set, the numbers of
    shingles per group, and the rarest shingles, of which two sets that similar share one."""
    spark = rows.sparkSession
    frequency = spark.sparkContext.broadcast(_histogram(rows.select("text"), length))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = frequency.value
        for batch in batches:
            for first, shingles, limits in _sets(batch.column(1), length):
                n = np.diff(limits)
                owner = np.repeat(np.arange(len(n)), n)
                sums = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scramble(shingles ^ np.uint64(salt)), dtype=np.uint64)))
                    sums.append((run[limits[1:]] - run[limits[:-1]]).view(np.int64))
                group = owner * GROUPS + (shingles >> np.uint64(59)).astype(np.int64)
                vectors = np.bincount(group, minlength=len(n) * GROUPS).astype(np.int32)
                order = np.lexsort((scramble(shingles), rare[(shingles % np.uint64(SLOTS)).astype(np.int64)], owner))
                rank = np.arange(len(owner)) - limits[:-1][owner]
                wanted = n - (-(-percent * n // 100)) + 1
                keys = shingles[order][rank < wanted[owner]].view(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.minimum(wanted, n))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.array(_narrow(vectors.reshape(-1, GROUPS)), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys)),
                    ],
                    ["id", "n", "sig", "sig2", "vector", "keys"],
                )

    schema = "id long, n long, sig long, sig2 long, vector binary, keys array<long>"
    made = stored(rows.mapInArrow(describe, schema), "jaccard-sets")
    frequency.unpersist()
    return made


def _shared_keys(known: DataFrame, rep: DataFrame) -> tuple[DataFrame, Broadcast]:
    """``key, id, n, place``: the prefix keys that may be in two sets or more, with their rank in the set, of the sets in
    ``rep``. Keys meet ``rep`` as one row per set. Also the filter it uses, to be given back when the rows are stored."""
    twice = known.sparkSession.sparkContext.broadcast(collect_bits(known.select("keys"), _flat_keys, 2)[0])
    own = ["id", "n", "sig", "sig2"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = next(_flat_keys(batch.select(["keys"])))
            sizes = batch.column("keys").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            stay = holds(twice.value, keys)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[stay], minlength=len(sizes)))))
            lists = [
                pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()) for values in (keys[stay], place[stay])
            ]
            made = pa.RecordBatch.from_arrays([*batch.select(own).columns, *lists], [*own, "keys", "places"])
            yield made.filter(pa.array(np.diff(ends) > 0))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("keys", np.int64), ("places", np.int32)))
            sizes = np.array([len(x) // 8 for x in batch.column("keys").to_pylist()], np.int64)
            owner = batch.select(["id", "n"]).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            columns = [pa.array(keys), *owner.columns, pa.array(places.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "n", "place"])

    packed = known.mapInArrow(keep, "id long, n long, sig long, sig2 long, keys binary, places binary")
    return packed.join(rep, own, "left_semi").mapInArrow(spread, "key long, id long, n long, place long"), twice


def _members(keyed: DataFrame) -> DataFrame:
    """``key, id, n, place, least, m, at``: the buckets of two ids or more, each row with the smallest id of its bucket
    and that one's ``n`` and ``place``. Rows are dealt by key once and pass in order, so no bucket is held."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of a bucket, until a second id shows
        first = None  # the first row of the bucket that is open
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                columns = [np.concatenate(([old], new)) for old, new in zip(held, columns)]
            key, ids = columns[:2]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
            heads = [c[begin].copy() for c in columns]
            known = first is not None and held is None and first[0] == key[0]
            if known:
                for head, value in zip(heads, first):
                    head[0] = value
            several = np.maximum.reduceat(ids, begin) != heads[1]
            if known:
                several[0] = True
            open_, held = len(begin) - 1, None
            if not several[open_]:
                held = [c[begin[open_]] for c in columns]
            first = [head[open_] for head in heads]
            at = np.flatnonzero(several[group])
            lead_ = [head[group[at]] for head in heads[1:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (*(c[at] for c in columns), *lead_)], ["key", "id", "n", "place", "least", "m", "at"]
            )

    dealt = keyed.repartition("key").sortWithinPartitions("key", "id", "place")
    return dealt.mapInArrow(lead, "key long, id long, n long, place long, least long, m long, at long")


def _flat_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _verified(pairs: DataFrame, rows: DataFrame, length: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets have the similarity, counted on the shingles themselves.

    The sets of all partners of an ``a`` go to its group, its own set goes there once; a group of many partners is dealt
    over several tasks. Sets are made in the scan and meet their groups in one shuffle.
    """
    pairs = stored(pairs, "jaccard-candidates")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    asks = pairs.join(parts, "a").select(F.col("b").alias("of"), "a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(1).alias("side"))
    asks = stored(asks, "jaccard-asks")
    holds_ = asks.select(F.col("a").alias("of"), "a", "part", F.lit(0).alias("side")).distinct()
    roles = stored(asks.unionByName(holds_), "jaccard-roles")
    ids = broadcast_if_small(roles.select("of").distinct(), IDS)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, shingles, limits in _sets(batch.column(1), length):
                made = [shingles[limits[i] : limits[i + 1]].tobytes() for i in range(len(limits) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(made)), pa.array(made, pa.binary())], ["id", "shingles"])

    sets = rows.join(ids, rows["id"] == ids["of"], "left_semi").mapInArrow(shingled, "id long, shingles binary")
    dealt = sets.join(broadcast_if_small(roles, IDS), F.col("id") == F.col("of")).select("a", "part", "side", "id", "shingles")
    dealt = dealt.repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for batch in batches:
            found = []
            for a, part, side, b, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                some = np.frombuffer(blob.as_buffer(), np.uint64)
                if (a, part) != group:
                    group, own = (a, part), []
                if not side:
                    own.append(some)
                    continue
                for one in own:
                    both = len(np.intersect1d(one, some, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(some) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], ["a", "b"])

    return stored(dealt.mapInArrow(compare, "a long, b long").distinct(), "jaccard-links")


def _narrow(vectors: np.ndarray) -> list[bytes]:
    """Each count vector in one, two or four bytes a coordinate, as its largest one needs."""
    most = vectors.max(axis=1, initial=0)
    return [v.astype(np.uint8 if m < 1 << 8 else np.uint16 if m < 1 << 16 else np.uint32).tobytes() for v, m in zip(vectors, most)]


def _vectors(column: pa.Array) -> np.ndarray:
    blobs = column.to_pylist()
    out, width = np.empty((len(blobs), GROUPS), np.int64), np.array([len(blob) // GROUPS for blob in blobs])
    for size in (1, 2, 4):
        mine = np.flatnonzero(width == size)
        out[mine] = np.frombuffer(b"".join(blobs[i] for i in mine), f"u{size}").reshape(-1, GROUPS)
    return out


def _fits(m, n, i, j, percent: int):
    """Whether sets of m and n shingles with a first common key at ranks i and j can be similar, by size and rank."""
    least = needed(m, n, percent)
    return (np.minimum(m, n) >= least) & (1 + np.minimum(m - 1 - i, n - 1 - j) >= least)


def _candidates(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs of different labels in the same bucket that the tree's bound allows.

    ``members``: ``key, id, n, place, label``; ``points``: ``id, n, vector``. A bucket is cut into blocks by size; blocks whose sizes fit are
    paired in separate groups: one block's points are searched in a tree of the other's.
    """
    numbered = members.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("key").orderBy("n", "id")) - 1) / BLOCK))
    numbered = stored(numbered.join(points, ["id", "n"]), "jaccard-blocks")
    blocks = numbered.groupBy("key", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = blocks.select("key", F.col("block").alias("into"), F.col("low").alias("into_low"))
    fits = (F.col("block") < F.col("into")) & (F.col("high") * 100 >= F.col("into_low") * percent)
    meetings = stored(blocks.join(other, "key").where(fits).select("key", "block", "into"), "jaccard-meetings")
    rest = ["id", "n", "place", "vector", "label"]
    own = numbered.select("key", F.col("block").alias("x"), F.col("block").alias("y"), F.lit(0).alias("side"), *rest)
    asks = numbered.join(meetings, ["key", "block"]).select("key", F.col("block").alias("x"), F.col("into").alias("y"), F.lit(0).alias("side"), *rest)
    into = meetings.select("key", F.col("block").alias("x"), F.col("into").alias("block"))
    sought = numbered.join(into, ["key", "block"]).select("key", "x", F.col("block").alias("y"), F.lit(1).alias("side"), *rest)
    dealt = own.unionByName(asks).unionByName(sought).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            ids, n, place, label = (table.column(c).to_numpy() for c in ("id", "n", "place", "label"))
            side, vectors = table.column("side").to_numpy(), _vectors(table.column("vector"))
            edges = group_edges(table, 3)
            sizes = np.diff(edges)
            group = np.repeat(np.arange(len(sizes)), sizes)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            leaf = (sizes <= LEAF)[group] & (table.column("x").to_numpy() == table.column("y").to_numpy())
            for step in range(1, LEAF):
                i = np.flatnonzero(leaf[:-step] & (group[:-step] == group[step:]) & (label[:-step] != label[step:]))
                i = i[np.minimum(vectors[i], vectors[i + step]).sum(axis=1) >= needed(n[i], n[i + step], percent)]
                a.append(i)
                b.append(i + step)
            for g in np.flatnonzero(~leaf[edges[:-1]]) if len(leaf) else ():
                at = np.arange(edges[g], edges[g + 1])
                hold = at[side[at] == 1] if side[at].any() else at
                ask = at[side[at] == 0]
                tree = CountTree(vectors[hold], n[hold], label[hold])
                q, p = tree.search(vectors[ask], n[ask], label[ask], percent)
                a.append(ask[q])
                b.append(hold[p])
            i, j = np.concatenate(a), np.concatenate(b)
            stay = _fits(n[i], n[j], place[i], place[j], percent)
            low, high = np.minimum(ids[i], ids[j])[stay], np.maximum(ids[i], ids[j])[stay]
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    return dealt.mapInArrow(search, "a long, b long").where("a <> b").distinct()


def near_duplicates(
    docs: DataFrame, length: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: components of documents linked by Jaccard similarity.

    A set holds the distinct shingles of ``length`` words of the text with A-Z lowered; a shorter text is one shingle,
    a text without words (or null) is empty and alone. Sets of intersection * 100 >= union * ``percent`` are linked.
    The component is the smallest id reachable. Rows of one id are one document: all its rows get its component. A null
    id sorts before all others. An empty table gives no rows.

    1. Equal sets are reduced to their smallest id. 2. Each set goes to the buckets of its rarest shingles, so many
    that similar sets must share a bucket (any order is exact; a histogram over all documents makes it a good one).
    3. Each set is compared with one smallest id of its buckets; verified links give first components. 4. In
    buckets that hold several components, an R-tree over count vectors finds the pairs of different components whose
    overlap bound, the sum of coordinate minima, allows the similarity; these are verified on the shingles. Pairs
    inside a component are never made, so a group of thousands of copies costs one comparison each.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(known_id(id_column).alias("id"), F.col(text_column).alias("text"))
    known = _prefixes(rows, length, percent)
    some = known.where("n > 0")
    firsts = stored(some.groupBy("sig", "sig2", "n").agg(F.min("id").alias("rep")), "jaccard-firsts")
    rep = firsts.select(F.col("rep").alias("id"), "sig", "sig2", "n")
    own = ["id", "sig", "sig2", "n"]
    shared, twice = _shared_keys(known, rep)
    members = stored(_members(shared), "jaccard-members")
    twice.unpersist()
    points = some.select(*own, "vector").join(rep, own, "left_semi").dropDuplicates(own).select("id", "n", "vector")
    points = stored(points, "jaccard-points")

    star = members.where("id <> least").where(F.least("m", "n") * (100 + percent) >= (F.col("m") + F.col("n")) * percent)
    star = star.where(
        (1 + F.least(F.col("m") - 1 - F.col("at"), F.col("n") - 1 - F.col("place"))) * (100 + percent) >= (F.col("m") + F.col("n")) * percent
    )
    # Of several smallest ids the one that shares most keys; what that misses is left to the trees.
    weighed = star.groupBy(F.col("id").alias("b"), F.col("least").alias("a")).agg(F.count("*").alias("keys"))
    star = weighed.groupBy("b").agg(F.max_by("a", F.struct("keys", F.bitwise_not("a"))).alias("a")).select("a", "b")
    links = _verified(_bounded(star, points, percent), rows, length, percent)
    labels = components(links)
    components_of = broadcast_if_small(labels, IDS)

    def labelled(rows: DataFrame) -> DataFrame:
        with_label = rows.select("key", "id", "n", "place").join(components_of, F.col("id") == F.col("node"), "left")
        return with_label.select("key", "id", "n", "place", F.coalesce("label", "id").alias("label"))

    # Only the few buckets of several components are written with their labels.
    mixed = labelled(members).groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    mixed = stored(mixed.select("key"), "jaccard-mixed")
    open_ = stored(labelled(members.join(broadcast_if_small(mixed, IDS), "key", "left_semi")), "jaccard-open")
    more = _verified(_candidates(open_, points, percent), rows, length, percent)
    labels = components(links.unionByName(more))

    named = known.select("id", "n", "sig", "sig2").join(firsts, ["sig", "sig2", "n"], "left").select(
        "id", "n", F.coalesce("rep", "id").alias("rep")
    )
    placed = named.join(broadcast_if_small(labels, IDS), F.col("rep") == F.col("node"), "left")
    own = placed.select("id", "n", F.coalesce("label", "rep").alias("component"))
    return own.select(
        id_or_null(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), id_or_null(F.col("component")).alias("component_id")
    )


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose count vectors allow the similarity."""
    left = points.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("vector").alias("left"))
    right = points.select(F.col("id").alias("b"), F.col("n"), F.col("vector").alias("right"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                overlap = np.minimum(_vectors(batch.column("left")), _vectors(batch.column("right"))).sum(axis=1)
                least = needed(batch.column("m").to_numpy(), batch.column("n").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(overlap >= least))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "left", "right")
    return joined.mapInArrow(bound, "a long, b long")


def keep_one_of_each(
    docs: DataFrame, length: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` without the rows whose component holds a smaller id. Of rows that repeat an id, all or none stay."""
    found = near_duplicates(docs, length, percent, id_column, text_column)
    gone = stored(found.where("NOT doc_id <=> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "jaccard-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).alias("of"))
    return rows.join(broadcast_if_small(gone, IDS), F.col("of").eqNullSafe(F.col("_gone")), "left_anti").select("row.*")
