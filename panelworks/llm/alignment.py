"""Alignment of two tokenizers over a corpus, and how often their tokens meet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelworks.llm.folding import PARTIAL, fold_tree
from panelworks.llm.perfect import PerfectHash, build
from panelworks.llm.staging import stored
from panelworks.llm.tokens import FOLDER, coder, read_vocabularies

#: Pairs whose hash, keys and counts are sent at once (about 17 bytes each); with more, the corpus is read in rounds.
AT_ONCE = 1 << 22
#: Slots of one segment of a dense count vector.
SEGMENT = 1 << 12
#: A task's count vector is worth sending if it read so many links per slot; else tasks take more input each.
LINKS_PER_SLOT = 4
_TEXT, _TOKENS, _HELD = 1 << 21, 1 << 20, 1 << 20


@dataclass
class Links:
    """Overlapping token pairs of some documents in order, the document of each, and which tokens end a group."""

    key: np.ndarray
    doc: np.ndarray
    a_ends_group: np.ndarray
    b_ends_group: np.ndarray


def link(a: np.ndarray, b: np.ndarray, docs: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Links:
    """Links of documents laid end to end. ``docs`` is where each document's bytes end.

    Every stretch between neighbouring token ends, of either kind, is where just one pair overlaps.
    """
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    mark = np.zeros(int(a_ends[-1]) + 1 if len(a) else 1, np.uint8)
    mark[a_ends] |= 1
    mark[b_ends] |= 2
    ends = np.flatnonzero(mark)
    kind = mark[ends]
    of_a = np.cumsum(kind & 1, dtype=np.int64) - (kind & 1)
    of_b = np.cumsum(kind >> 1, dtype=np.int64) - (kind >> 1)
    key = a[of_a].astype(np.uint64) * np.uint64(len(b_sizes)) + b[of_b]
    doc = np.searchsorted(docs, ends, "left")
    return Links(key, doc, mark[a_ends] == 3, mark[b_ends] == 3)


def _slices(batch: pa.RecordBatch, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, ids of both kinds and document ends of consecutive rows with about _TOKENS tokens together."""
    a_ids = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("a")]
    b_ids = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("b")]
    first = 0
    while first < len(a_ids):
        last, held = first, 0
        while last < len(a_ids) and (last == first or held + len(a_ids[last]) <= _TOKENS):
            held += len(a_ids[last])
            last += 1
        sizes = [int(a_sizes[x].sum()) for x in a_ids[first:last]]
        yield first, np.concatenate(a_ids[first:last]), np.concatenate(b_ids[first:last]), np.cumsum(sizes)
        first = last


def encoded(docs: DataFrame, folder: str = FOLDER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``row, doc_id, n_a, n_b, a, b``: ids of both tokenizers as 16-bit numbers, written once, numbered by row.

    Both vocabulary files are read by the driver and sent. A text is encoded whole.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(read_vocabularies(folder))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coder(given.value)
        for batch in batches:
            first, held = 0, 0
            sizes = batch.column(2).cast(pa.large_string()).fill_null("")
            for last, text in enumerate(sizes, 1):
                held += len(text.as_buffer())
                if held < _TEXT and last < batch.num_rows:
                    continue
                ids = both.encode(batch.column(2)[first:last].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:last],
                        batch.column(1)[first:last],
                        *(pa.array([len(x[i]) for x in ids], pa.int64()) for i in range(2)),
                        *(pa.array([x[i].tobytes() for x in ids], pa.binary()) for i in range(2)),
                    ],
                    ["row", "doc_id", "n_a", "n_b", "a", "b"],
                )
                first, held = last, 0

    made = rows.mapInArrow(encode, f"row long, doc_id {kind}, n_a long, n_b long, a binary, b binary")
    return stored(made, "tokens", compression="zstd")


def distinct_pairs(tokens: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The distinct pairs of linked ids as long ``key``: first id times the second vocabulary's size plus second id."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            for _, a, b, docs in _slices(batch, *sizes):
                held = np.unique(np.concatenate((held, np.unique(link(a, b, docs, *sizes).key))))
                if len(held) > _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], ["key"])
                    held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], ["key"])

    return tokens.select("a", "b").mapInArrow(find, "key long").distinct()


def _smallest(counts: np.ndarray) -> bytes:
    """A count vector in the narrowest width that holds it, with that width first."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def _widened(state: bytes) -> np.ndarray:
    return np.frombuffer(state, np.dtype(f"u{state[0]}"), offset=1).astype(np.int64)


def count_pairs(tokens: DataFrame, known: PerfectHash, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``key, state``: segments of the count vector over the slots of ``known``, for all documents.

    Each task fills a dense vector; these are summed by a tree, segment by segment.
    """
    sent = tokens.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, total = sent.value, np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for _, a, b, docs in _slices(batch, *sizes):
                pairs, times = np.unique(link(a, b, docs, *sizes).key, return_counts=True)
                at = slots.index(pairs)
                total[at[at >= 0]] += times[at >= 0]
        segments = [i for i in range(0, len(total), SEGMENT) if total[i : i + SEGMENT].any()]
        lot = TaskContext.get().partitionId()
        states = [_smallest(total[i : i + SEGMENT]) for i in segments]
        columns = [pa.array([i // SEGMENT for i in segments], pa.int64()), pa.array([lot] * len(states), pa.int64()), pa.array(states, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "lot", "state"])

    def add(states: Iterator[bytes]) -> bytes:
        return _smallest(sum(_widened(state) for state in states))

    return fold_tree(tokens.select("a", "b").mapInArrow(count, PARTIAL), add, "pair-counts")


def _dense(segments: DataFrame, slots: int) -> np.ndarray:
    counts = np.zeros(slots, np.int64)
    for row in segments.toLocalIterator():
        part = _widened(row["state"])
        counts[row["key"] * SEGMENT : row["key"] * SEGMENT + len(part)] = part
    return counts


class _Spelling:
    """Ids in decimal with the sign that follows, as rows of bytes to gather from."""

    def __init__(self, ids: int) -> None:
        written = [str(i).encode() for i in range(ids)]
        width = max(map(len, written)) + 1
        self.size = np.array([len(x) for x in written], np.int64)
        self.letters = np.array([np.frombuffer(x.ljust(width), np.uint8) for x in written])

    def spell(self, ids: np.ndarray, last: np.ndarray, inside: bytes, after: bytes) -> tuple[np.ndarray, np.ndarray]:
        out = self.letters[ids]
        out[np.arange(len(ids)), self.size[ids]] = np.where(last, after[0], inside[0])
        return out, self.size[ids] + 1


def groups_text(a: np.ndarray, b: np.ndarray, found: Links, a_doc: np.ndarray, b_doc: np.ndarray, docs: int, spelling: _Spelling) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each of ``docs`` documents."""
    if not len(a):
        return [b""] * docs
    (letters_a, size_a) = spelling.spell(a, found.a_ends_group, b",", b"|")
    (letters_b, size_b) = spelling.spell(b, found.b_ends_group, b",", b";")
    group_a = np.cumsum(found.a_ends_group) - found.a_ends_group
    group_b = np.cumsum(found.b_ends_group) - found.b_ends_group
    # Before a token stand those of its kind before it and, of the other kind, the first's of its group and all earlier ones.
    before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b))))[group_a]
    upto_a = np.cumsum(np.bincount(group_a))[group_b]
    where = np.concatenate((np.arange(len(a)) + before_b, np.arange(len(b)) + upto_a))
    letters, size = np.empty((len(where), letters_a.shape[1]), np.uint8), np.empty(len(where), np.int64)
    letters[where], size[where] = np.concatenate((letters_a, letters_b)), np.concatenate((size_a, size_b))
    data = letters[np.arange(letters.shape[1]) < size[:, None]].tobytes()
    length = np.bincount(a_doc, weights=size_a, minlength=docs) + np.bincount(b_doc, weights=size_b, minlength=docs)
    ends = np.cumsum(length).astype(np.int64).tolist()
    return [data[end - n : end - 1] if n else b"" for end, n in zip(ends, length.astype(np.int64).tolist())]


_FOUND = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align(
    docs: DataFrame, folder: str = FOLDER, at_once: int = AT_ONCE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Tokens, groups and links of every document, and how common its links are in the whole corpus.

    Returns one row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``. Groups end where
    tokens of both kinds end; a link is a pair of tokens whose bytes overlap, its count how many links hold its pair of
    ids in all documents; ``n_best`` are links whose count is the highest of their second id. ``groups`` spells the ids,
    ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and texts that the tokens of one kind don't spell, have no tokens:
    zeros and an empty string, and no part in counts. Repeated rows count each; null ids get rows; other columns are
    not read; an empty table gives none.

    Texts are encoded once. The distinct pairs get a minimal perfect hash, and counts are dense vectors over it. Hash,
    keys and counts of ``at_once`` pairs at most are sent to the tasks; with more pairs there are several rounds, each
    over a range of the hash's buckets, which read the ids again and add up per document.
    """
    spark = docs.sparkSession
    tokens = encoded(docs, folder, id_column, text_column)
    both = coder(read_vocabularies(folder))
    sizes = (both.a_sizes, both.b_sizes)
    second = len(both.b_sizes)
    pairs = stored(distinct_pairs(tokens, sizes), "pairs")
    many = pairs.count()
    perfect = stored(build(pairs, many), "pairs-hash")
    buckets = perfect.agg(F.max("of")).first()[0] or 1
    rounds = min(buckets, max(1, -(-many // at_once)))
    spread = tokens.agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0] or 0
    counting = tokens.coalesce(max(1, spread // (LINKS_PER_SLOT * max(1, -(-many // rounds)))))

    def part(turn: int) -> PerfectHash:
        low, high = turn * buckets // rounds, (turn + 1) * buckets // rounds
        return PerfectHash(perfect.where((F.col("bucket") >= low) & (F.col("bucket") < high)).collect())

    counted, best = [], np.zeros(second, np.int64)
    for turn in range(rounds):
        known = part(turn)
        counted.append(count_pairs(counting, known, sizes))
        np.maximum.at(best, (known.keys % np.uint64(second)).astype(np.int64), _dense(counted[-1], len(known)))
    results = []
    for turn in range(rounds):
        known = part(turn)
        sent = spark.sparkContext.broadcast((known, _dense(counted[turn], len(known)), best))
        results.append(_looked_up(tokens, sent, sizes, spelled=turn == 0))
    if rounds == 1:
        return results[0].drop("row")
    rest = results[1].select("row", "n_best", "count_sum")
    for result in results[2:]:
        rest = rest.unionByName(result.select("row", "n_best", "count_sum"))
    added = rest.groupBy(F.col("row").alias("of")).agg(F.sum("n_best").alias("more"), F.sum("count_sum").alias("sum"))
    joined = results[0].join(added, F.col("row") == F.col("of"))
    return joined.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.col("more")).alias("n_best"), (F.col("count_sum") + F.col("sum")).alias("count_sum"), "groups"
    )


def _looked_up(tokens: DataFrame, sent, sizes: tuple[np.ndarray, np.ndarray], spelled: bool) -> DataFrame:
    """Documents aligned again, their links looked up among the pairs that were sent; ``groups`` only if ``spelled``."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = sent.value
        of_b = (known.keys % np.uint64(len(sizes[1]))).astype(np.int64)
        top = counts == best[of_b]
        spelling = _Spelling(max(map(len, sizes))) if spelled else None
        for batch in batches:
            n_a, n_b = (batch.column(name).to_numpy() for name in ("n_a", "n_b"))
            for first, a, b, ends in _slices(batch, *sizes):
                docs = len(ends)
                found = link(a, b, ends, *sizes)
                at = known.index(found.key)
                doc, at = found.doc[at >= 0], at[at >= 0]
                rows = slice(first, first + docs)
                a_doc, b_doc = np.repeat(np.arange(docs), n_a[rows]), np.repeat(np.arange(docs), n_b[rows])
                sums = np.zeros(docs, np.int64)
                np.add.at(sums, doc, counts[at])
                numbers = [
                    n_a[rows],
                    n_b[rows],
                    np.bincount(a_doc[found.a_ends_group], minlength=docs),
                    np.bincount(found.doc, minlength=docs),
                    np.bincount(doc[top[at]], minlength=docs),
                    sums,
                ]
                texts = groups_text(a, b, found, a_doc, b_doc, docs, spelling) if spelled else [None] * docs
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row")[rows],
                        batch.column("doc_id")[rows],
                        *(pa.array(x.astype(np.int64)) for x in numbers),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
                )

    return tokens.mapInArrow(look_up, f"row long, doc_id {kind}, {_FOUND}")
