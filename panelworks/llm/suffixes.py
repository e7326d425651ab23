"""Repeated byte strings of all documents, found by column-wise sorting of aligned pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelworks.llm.bits import collect_bits, holds, is_set, slots
from panelworks.llm.columns import insert_columns
from panelworks.llm.staging import id_or_null, known_id, stored, with_spans
from panelworks.llm.words import groups, hashes, long_ids, rolling_hashes, scramble, slices

LENGTH = 100
#: An anchor that falls into a slot seen so often is common; a string is dealt by another one where it has any.
COMMON = 64
#: Groups of anchors per shuffle partition: two, so that their hashed numbers fill partitions more evenly.
GROUPS_PER_PARTITION = 2
#: Bytes that are worked on at once. Longer texts are cut into such segments, which overlap by LENGTH - 1 bytes.
SEGMENT = 1 << 19
_PLACE_BITS = 23
_HASH_BITS = 63 - _PLACE_BITS
#: Pieces that are sorted at once in a task; equal strings always are in the same group of pieces.
PIECES = 60_000
_COLUMNS = ["bucket", "keys", "ids", "places", "leads", "sizes", "text"]
_SCHEMA = "bucket int, keys binary, ids binary, places binary, leads binary, sizes binary, text binary"


def _segments(texts: pa.Array, overlap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, bytes, offsets of each text in these, and the place of the first byte in its text."""
    for first, data, offsets in slices(texts, SEGMENT):
        if len(offsets) > 2 or len(data) <= SEGMENT + overlap:
            yield first, data, offsets, 0
            continue
        for begin in range(0, len(data) - overlap, SEGMENT):
            part = data[begin : begin + SEGMENT + overlap]
            yield first, part, np.array([0, len(part)]), begin


def _strings(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of every string of ``length`` bytes inside one text."""
    whole = rolling_hashes(data, length, seed)
    valid = np.ones(len(whole), bool)
    for end in offsets[1:-1]:
        valid[max(end - length + 1, 0) : end] = False
    return np.flatnonzero(valid), whole[valid]


class Anchors:
    """Filters of anchors (strings of half the length): which may stand at two places, and which are common."""

    def __init__(self, twice: list[np.ndarray], again: list[np.ndarray], common: np.ndarray) -> None:
        self.twice, self.again, self.common = twice, again, common

    def repeated(self, anchor: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(holds(self.twice, anchor))
        out = np.zeros(len(anchor), bool)
        out[some] = holds(self.again, scramble(anchor[some]))
        return out


def _anchors(rows: DataFrame, length: int) -> Anchors:
    """A reference block and an equal string elsewhere make an anchor repeated.

    One pass indexes the blocks, a second counts every string that may be one; a third counts those again that seem to
    be at two places, by other slots, which leaves few by chance.
    """
    half = (length + 1) // 2

    def blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, offsets, place in _segments(batch.column(1), length - 1):
            text = [offsets[i] + np.arange(-place % half, n - half + 1, half) for i, n in enumerate(np.diff(offsets))]
            begins = np.concatenate(text)
            yield hashes(data, begins, begins + half, seed=9)

    sc = rows.sparkSession.sparkContext
    index = sc.broadcast(collect_bits(rows, blocks, 1)[0])

    def probes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, offsets, _ in _segments(batch.column(1), length - 1):
            anchor = _strings(data, offsets, half, seed=9)[1]
            yield anchor[holds(index.value, anchor)]

    found, common = collect_bits(rows, probes, 2, COMMON)
    index.unpersist()
    twice = sc.broadcast(found)

    def seen(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, offsets, _ in _segments(batch.column(1), length - 1):
            anchor = _strings(data, offsets, half, seed=9)[1]
            yield scramble(anchor[holds(twice.value, anchor)])

    again = collect_bits(rows, seen, 2)[0]
    twice.unpersist()
    return Anchors(found, again, common[0])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    run, size = values, 1
    while size * 2 <= width:
        run, size = np.minimum(run[:-size], run[size:]), size * 2
    rest = width - size
    return np.minimum(run[: len(run) - rest], run[rest:]) if rest else run


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, anchors: Anchors):
    """Begin, number of strings, anchor hash and place of the anchor of each piece: consecutive strings that may repeat
    and that have the same least anchor. Equal strings have it at the same place, so they meet under the same hash."""
    half = (length + 1) // 2
    width = length - half + 1
    none = np.zeros(0, np.int64)
    begins, anchor = _strings(data, offsets, half, seed=9)
    repeated = anchors.repeated(anchor)
    own = np.flatnonzero(repeated)
    if len(data) < length or not len(own):
        return none, none, none, none
    rank = (anchor >> np.uint64(64 - _HASH_BITS)) << np.uint64(_PLACE_BITS) | begins.astype(np.uint64)
    rank[own] |= is_set(anchors.common, slots(anchor[own], 0)).astype(np.uint64) << np.uint64(63)
    least = np.full(len(data), np.iinfo(np.uint64).max, np.uint64)
    least[begins] = rank
    upto = np.zeros(len(data) + 2, np.int64)
    upto[begins[own] + 1] = 1
    upto = np.cumsum(upto)
    owner_end = np.repeat(offsets[1:], np.diff(offsets))
    start = np.arange(len(data) - length + 1)
    start = start[(start + length <= owner_end[: len(start)]) & (upto[start + width] > upto[start])]
    if not len(start):
        return none, none, none, none
    place = (_sliding_min(least, width)[start] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    many = np.diff(np.concatenate((first, [len(start)])))
    hashed = anchor[np.searchsorted(begins, place[first])]
    return start[first], many, hashed.view(np.int64), place[first]


def _sent(columns: list[np.ndarray], key: np.ndarray, text: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """Rows of blobs by key: the columns of the pieces, and their bytes if ``text`` gives data, and begins and sizes of
    their ranges (a row of them for each piece)."""
    order = np.argsort(key, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
    parts = [order[a:b] for a, b in zip(edges[:-1], edges[1:])]
    arrays = [pa.array(key[order][edges[:-1]] if len(order) else [], pa.int32())]
    arrays += [pa.array([column[p].tobytes() for p in parts], pa.binary()) for column in columns]
    if text is not None:
        data, begins, sizes = text
        arrays.append(pa.array([data[_ranges(begins[p].ravel(), sizes[p].ravel())].tobytes() for p in parts], pa.binary()))
    return arrays


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


def _blob(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _later_strings(symbols: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each row and column whether its ``length`` symbols from there also stand there in a row of lower rank."""
    later = np.zeros((len(symbols), symbols.shape[1] - length + 1), bool)
    for column, order, common in insert_columns(symbols):
        if column >= later.shape[1]:
            continue
        head = np.flatnonzero(common < length)
        if len(head) == len(order):
            continue
        ranked = rank[order]
        first = np.repeat(np.minimum.reduceat(ranked, head), np.diff(np.concatenate((head, [len(order)]))))
        later[order, column] = ranked != first
    return later


def repeated_ranges(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, spans``: the byte ranges (pairs of 32-bit begin and end) covered by strings that also start earlier.

    1. Two filters of fixed size leave the strings that hold an anchor seen at two places (an aligned block, and any
    place). 2. Consecutive ones that share their least anchor, common ones last, are a piece; pieces go to groups by
    that anchor, aligned at it, and equal strings meet there in one column. A slice sends equal pieces once, for the
    first; the strings of the others are repeats. 3. Each group is sorted column by column, one symbol per piece and
    round, with its common prefixes; rows that share ``length`` symbols are equal strings, and all but the earliest
    start are repeats. 4. What overlaps or touches in a document is one maximal range.
    """
    spark = docs.sparkSession
    rows = docs.select(known_id(id_column).alias("id"), F.col(text_column).alias("text"))
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = GROUPS_PER_PARTITION * owners
    filters = spark.sparkContext.broadcast(_anchors(rows, length))
    half = (length + 1) // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = long_ids(batch.column(0), 0)
            for first, data, offsets, place in _segments(batch.column(1), length - 1):
                begin, many, key, anchor = _pieces(data, offsets, length, filters.value)
                text = np.searchsorted(offsets, begin, "right") - 1
                doc, at, size = ids[first + text], begin - offsets[text] + place, many + length - 1
                one, two = hashes(data, begin, begin + size, 10), hashes(data, begin, begin + size, 11)
                order = np.lexsort((at, doc, two, one))
                new = np.ones(len(order), bool)
                new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
                same = np.zeros(len(order), bool)
                same[order] = ~new & ((doc[order] != doc[lead]) | (at[order] != at[lead]))
                for copies in (False, True):
                    p = np.flatnonzero(same == copies)
                    lead = (anchor - begin)[p]
                    columns = [key[p], doc[p], at[p].astype(np.int32), lead.astype(np.uint16), size[p].astype(np.uint16)]
                    bucket = np.abs(doc[p]) % owners if copies else np.abs(key[p]) % buckets
                    around = np.stack((begin[p], anchor[p] + half), axis=1), np.stack((lead, size[p] - half - lead), axis=1)
                    arrays = _sent(columns, bucket, None if copies else (data, *around))
                    if copies:
                        arrays.append(pa.nulls(len(arrays[0]), pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, _COLUMNS)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            known = table.filter(pc.is_null(table.column("text")))
            if known.num_rows:
                begin = _blob(known, "places", np.int32)
                yield from _told(_blob(known, "ids", np.int64), begin, begin + _blob(known, "sizes", np.uint16), owners)
            table = table.filter(pc.is_valid(table.column("text")))
            if table.num_rows:
                yield from _sorted_bucket(table, length, owners)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            doc, begin, end = (_blob(table, name, kind) for name, kind in (("ids", np.int64), ("begins", np.int32), ("ends", np.int32)))
            order = np.lexsort((begin, doc))
            doc, begin, end = doc[order], begin[order], end[order]
            # Ends of all ranges so far in a document, as a running maximum over numbered documents.
            number = np.cumsum(np.concatenate(([0], np.diff(doc) != 0))) << 32
            reach = np.maximum.accumulate(number + end)
            apart = np.ones(len(doc), bool)
            apart[1:] = (number + begin)[1:] > reach[:-1]
            head = np.flatnonzero(apart)
            last = np.concatenate((head[1:], [len(doc)])) - 1
            pairs = np.stack((begin[head], (reach - number)[last]), axis=1).astype(np.int32)
            own = np.flatnonzero(np.concatenate(([True], np.diff(doc[head]) != 0)))
            spans = [pairs[a:b].tobytes() for a, b in zip(own, np.concatenate((own[1:], [len(head)])))]
            yield pa.RecordBatch.from_arrays([pa.array(doc[head][own]), pa.array(spans, pa.binary())], ["id", "spans"])

    pieces = rows.mapInArrow(send, _SCHEMA).repartition("bucket").sortWithinPartitions("bucket")
    found = pieces.mapInArrow(sort, "owner int, ids binary, begins binary, ends binary")
    return stored(found.repartition("owner").sortWithinPartitions("owner").mapInArrow(merge, "id long, spans binary"), "suffix-spans")


def _told(doc: np.ndarray, begin: np.ndarray, end: np.ndarray, owners: int) -> Iterator[pa.RecordBatch]:
    if len(doc):
        arrays = _sent([doc, begin.astype(np.int32), end.astype(np.int32)], np.abs(doc) % owners, None)
        yield pa.RecordBatch.from_arrays(arrays, ["owner", "ids", "begins", "ends"])


def _sorted_bucket(table: pa.Table, length: int, owners: int) -> Iterator[pa.RecordBatch]:
    """Sort the pieces of a bucket, whole anchors at a time and about PIECES at once, and tell what is repeated.

    A row is a piece's bytes before its anchor, the anchor as one symbol, and the bytes behind it.
    """
    half = (length + 1) // 2
    side = length - half
    key, doc = _blob(table, "keys", np.int64), _blob(table, "ids", np.int64)
    place, lead = _blob(table, "places", np.int32).astype(np.int64), _blob(table, "leads", np.uint16).astype(np.int64)
    size, text = _blob(table, "sizes", np.uint16).astype(np.int64), _blob(table, "text", np.uint8)
    sent = size - half
    offset = np.cumsum(sent) - sent
    order = np.argsort(key, kind="stable")
    # An anchor with a single piece repeats nothing.
    _, inverse, many = np.unique(key, return_inverse=True, return_counts=True)
    order = order[many[inverse[order]] > 1]
    while len(order):
        cut = min(PIECES, len(order))
        if cut < len(order):
            sorted_ = key[order]
            cut = int(np.searchsorted(sorted_, sorted_[cut], "left")) or int(np.searchsorted(sorted_, sorted_[0], "right"))
        p, order = order[:cut], order[cut:]
        symbols = np.zeros((len(p), 2 * side + 1), np.uint16)
        symbols[:, side] = np.cumsum(np.concatenate(([1], np.diff(key[p]) != 0)))
        for column, begin, n in ((side - lead[p], offset[p], lead[p]), (np.full(len(p), side + 1), offset[p] + lead[p], sent[p] - lead[p])):
            symbols[np.repeat(np.arange(len(p)), n), _ranges(column, n)] = text[_ranges(begin, n)].astype(np.uint16) + 1
        # Rows are compared in one column, so the earlier string is that of the lower id and aligned place.
        aligned = place[p] + lead[p] - side
        by = np.lexsort((aligned, doc[p]))
        step = np.concatenate(([0], (np.diff(doc[p][by]) != 0) | (np.diff(aligned[by]) != 0)))
        rank = np.empty(len(p), np.int64)
        rank[by] = np.cumsum(step)
        later = np.pad(_later_strings(symbols, rank, side + 1), ((0, 0), (1, 1)))
        change = np.diff(later.astype(np.int8), axis=1)
        row, begin = np.nonzero(change == 1)
        end = np.nonzero(change == -1)[1]
        base = aligned[row]
        yield from _told(doc[p][row], base + begin, base + end - 1 + length, owners)


def without_repeated_strings(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) of every row: the bytes that no repeated string covers.

    A string is ``length`` consecutive bytes of one document's UTF-8 text; it is repeated if it also starts at a smaller
    id or earlier in the same document. All are judged on the input. Cuts may split characters, so ``kept`` is binary.
    Null and empty texts have no bytes; texts shorter than a string stay whole. A null id sorts before all others. Rows
    that share an id are read as the same document: equal starts of one id are no repeats of each other, and what is
    removed from one is removed from all. An empty table gives no rows.
    """
    spans = repeated_ranges(docs, length, id_column, text_column)
    rows = docs.select(known_id(id_column).alias("id"), F.col(text_column).alias("text"))
    joined = with_spans(rows, spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, span in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                pairs = np.frombuffer(span.as_buffer(), np.int32).reshape(-1, 2) if span.is_valid else np.zeros((0, 2), np.int32)
                pairs = np.minimum(pairs, len(data))
                edges = [0, *pairs.ravel().tolist(), len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(data), len(data) - len(left), int((pairs[:, 0] < pairs[:, 1]).sum()), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    made = joined.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return made.select(id_or_null(F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
