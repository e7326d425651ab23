"""Repeated word windows: fixed blocks as anchors, probed with every rolling window."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelworks.llm.bits import collect_bits, holds
from panelworks.llm.staging import id_or_null, known_id, stored, with_spans
from panelworks.llm.words import groups, hashes, long_ids, runs, slices, words

WINDOW = 20
#: Work of one group of starts, as groups per shuffle partition.
GROUPS_PER_PARTITION = 1
_SLICE = 1 << 21


def _hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first row, word hashes, owners, and the index of each text's first word (with the end)."""
    for first, data, offsets in slices(texts, _SLICE):
        begins, ends, owner = words(data, offsets)
        yield first, hashes(data, begins, ends), owner, np.searchsorted(owner, np.arange(len(offsets)))


def _anchors(rows: DataFrame, window: int) -> list[np.ndarray]:
    """Filters of the anchor hashes seen at two places: a reference block, and a rolling window elsewhere.

    Blocks of (window + 1) // 2 words lie side by side from each document's first word, so every window of the document
    holds a whole one, and an equal window elsewhere holds the same words at the same offset.
    """
    block = (window + 1) // 2

    def blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, hashed, owner, limits in _hashed(batch.column(1)):
            at, anchor = runs(hashed, owner, block, seed=6)
            yield anchor[(at - limits[owner[at]]) % block == 0] if len(at) else anchor

    sc = rows.sparkSession.sparkContext
    index = sc.broadcast(collect_bits(rows, blocks, 1)[0])

    def probes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, hashed, owner, _ in _hashed(batch.column(1)):
            anchor = runs(hashed, owner, block, seed=6)[1]
            yield anchor[holds(index.value, anchor)]

    found = collect_bits(rows, probes, 2)[0]
    index.unpersist()
    return found


def _starts(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """``bucket, ids, places, low, high``: starts of windows that hold an anchor seen twice, by hash of the window.

    A slice sends the first start of each of its windows; its later ones are known to be repeats and are marked by a
    window hash of none, so that a window of any frequency is sent once per slice.
    """
    block = (window + 1) // 2
    twice = rows.sparkSession.sparkContext.broadcast(_anchors(rows, window))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = long_ids(batch.column(0), 0)
            for first, hashed, owner, limits in _hashed(batch.column(1)):
                at, anchor = runs(hashed, owner, block, seed=6)
                hit = np.zeros(len(hashed) + 1, np.int64)
                if len(at):
                    hit[at + 1] = holds(twice.value, anchor)
                upto = np.cumsum(hit)
                start, low = runs(hashed, owner, window, seed=7)
                high = runs(hashed, owner, window, seed=8)[1]
                maybe = upto[start + window - block + 1] > upto[start]
                start, low, high = start[maybe], low[maybe], high[maybe]
                text = owner[start]
                doc, place = ids[first + text], start - limits[text]
                later = _later(doc, place, low, high)
                for kind in (False, True):
                    mine = np.flatnonzero(later == kind)
                    key = np.abs(doc[mine] if kind else low[mine].view(np.int64)) % buckets
                    order = np.lexsort((place[mine], text[mine], key))
                    mine, key = mine[order], key[order]
                    cuts = np.flatnonzero(np.diff(key)) + 1
                    edges = np.concatenate(([0], cuts, [len(mine)])) if len(mine) else np.zeros(1, np.int64)
                    many = len(edges) - 1
                    parts = [mine[edges[i] : edges[i + 1]] for i in range(many)]
                    columns = [
                        pa.array(key[edges[:-1]] if many else [], pa.int32()),
                        *(pa.array([column[p].tobytes() for p in parts], pa.binary()) for column in (doc, place.astype(np.int32))),
                        *(pa.array([b"" if kind else column[p].tobytes() for p in parts], pa.binary()) for column in (low, high)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "ids", "places", "low", "high"])

    return rows.mapInArrow(send, "bucket int, ids binary, places binary, low binary, high binary")


def _later(doc: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether an equal window starts earlier: at a smaller id, or at a smaller place of the same id."""
    order = np.lexsort((place, doc, high, low))
    out = np.zeros(len(order), dtype=bool)
    if len(order):
        new = np.ones(len(order), dtype=bool)
        new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        out[order] = (doc[order] != doc[lead]) | (place[order] != place[lead])
    return out


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, spans``: the word ranges (pairs of 32-bit begin and end) covered by windows that also start earlier.

    Hits of anchors are extended to all windows that hold them, these are compared by 128 bits of hash over all
    documents, and what overlaps or touches is one maximal range. Only documents with such a range have a row.
    """
    spark = docs.sparkSession
    rows = docs.select(known_id(id_column).alias("id"), F.col(text_column).alias("text"))
    buckets = GROUPS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            doc, place = _joined(group.column("ids"), np.int64), _joined(group.column("places"), np.int32)
            low, high = _joined(group.column("low"), np.uint64), _joined(group.column("high"), np.uint64)
            compared = np.repeat([len(x) > 0 for x in group.column("low").to_pylist()], [len(x) // 8 for x in group.column("ids").to_pylist()])
            later = np.ones(len(doc), dtype=bool)
            later[compared] = _later(doc[compared], place[compared], low, high)
            doc, place = doc[later], place[later]
            key = np.abs(doc) % buckets
            order = np.lexsort((place, doc, key))
            key, doc, place = key[order], doc[order], place[order]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
            pieces = list(zip(edges[:-1], edges[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[edges[:-1]] if len(key) else [], pa.int32()),
                    pa.array([doc[a:b].tobytes() for a, b in pieces], pa.binary()),
                    pa.array([place[a:b].tobytes() for a, b in pieces], pa.binary()),
                ],
                ["owner", "ids", "places"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            doc, place = _joined(group.column("ids"), np.int64), _joined(group.column("places"), np.int32)
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            apart = np.ones(len(doc), dtype=bool)
            apart[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + window)
            begin = np.flatnonzero(apart)
            end = np.concatenate((begin[1:], [len(doc)])) - 1
            pairs = np.stack((place[begin], place[end] + window), axis=1).astype(np.int32)
            own = np.flatnonzero(np.concatenate(([True], np.diff(doc[begin]) != 0))) if len(begin) else np.zeros(0, np.int64)
            edges = np.concatenate((own, [len(begin)]))
            spans = [pairs[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(doc[begin][own]), pa.array(spans, pa.binary())], ["id", "spans"])

    starts = _starts(rows, window, buckets).repartition("bucket").sortWithinPartitions("bucket")
    later = starts.mapInArrow(repeated, "owner int, ids binary, places binary").repartition("owner").sortWithinPartitions("owner")
    return stored(later.mapInArrow(merge, "id long, spans binary"), "repeats-spans")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row: the text without the words that a repeated window covers.

    Words are runs between ASCII white space, unchanged; a window is ``window`` consecutive words of one document, and
    it is repeated if the same words also start at a smaller id or earlier in the same document. All windows are judged
    on the input. Kept words are joined by one space. Null and empty texts have no words; texts shorter than a window
    stay whole. A null id sorts before all others. Rows that share an id are read as the same document: equal starts of
    one id are no repeats of each other, and what is removed from one is removed from all. An empty table gives none.
    """
    spans = repeated_spans(docs, window, id_column, text_column)
    rows = docs.select(known_id(id_column).alias("id"), F.col(text_column).alias("text"))
    joined = with_spans(rows, spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, span in zip(batch.column(1), batch.column(2)):
                tokens = (text.as_py() or "").encode().split()
                stay = np.ones(len(tokens), dtype=bool)
                if span.is_valid:
                    for begin, end in np.frombuffer(span.as_buffer(), np.int32).reshape(-1, 2):
                        stay[begin:end] = False
                    left = b" ".join(compress(tokens, stay))
                else:
                    left = b" ".join(tokens)
                total.append(len(tokens))
                removed.append(len(tokens) - int(stay.sum()))
                kept.append(left.decode())
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept"])

    made = joined.mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
    return made.select(id_or_null(F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")
