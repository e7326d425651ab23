"""Benchmark passages inside documents: SimHash of item-sized windows, Hamming blocks, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from panelworks.llm.staging import bound_batches, broadcast_if_small, stored
from panelworks.llm.words import hashes, runs, scramble, slices, words

SHINGLE, SIMILARITY = 5, 0.8
#: Items that one pass over the documents looks for, and code points of their texts. A larger benchmark takes more
#: passes, so that what is sent to the executors is bounded; an item longer than that is a pass of its own.
ITEMS, ITEM_CHARS = 20_000, 1 << 23
#: A fingerprint has BLOCKS blocks of 8 bits. Two that differ in at most RADIUS bits differ in at most one bit of one
#: block at least, so looking up every block with one bit turned finds all of them.
BLOCKS = 8
RADIUS = 2 * BLOCKS - 1
#: Windows whose bits are summed at a time, and pairs of windows and items whose fingerprints are compared at a time.
_WINDOWS, _PAIRS = 1 << 12, 1 << 19
_FILTER_BITS = 20
_BREAKS = np.ones(256, dtype=bool)
_BREAKS[128:] = False
_BREAKS[48:58] = _BREAKS[97:123] = False


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of lower-cased texts: first row, word hashes, their owners, number of texts. Punctuation separates.

    Only a slice at a time is lowered, never a whole batch.
    """
    for first, _, raw in slices(column):
        own = pc.utf8_lower(column.slice(first, len(raw) - 1).cast(pa.large_string()).fill_null(""))
        for within, data, offsets in slices(own):
            begins, ends, owner = words(data, offsets, _BREAKS)
            yield first + within, hashes(data, begins, ends, seed=3), owner, len(offsets) - 1


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers from ``first`` to ``last``, that one included, of each pair in turn."""
    n = np.maximum(last - first + 1, 0)
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def fingerprints(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the shingles from each start up to its end: of each bit the majority, repeats counted.

    Starts and ends do not fall; only shingles inside a window are looked at, each once.
    """
    made = np.zeros(len(starts), np.uint64)
    for low in range(0, len(starts), _WINDOWS):
        begin, end = starts[low : low + _WINDOWS], ends[low : low + _WINDOWS]
        used = _ranges(np.maximum(begin, np.concatenate(([0], end[:-1]))), end - 1)
        bits = np.unpackbits(scramble(shingles[used]).view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.zeros((len(used) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=ones[1:])
        at = np.searchsorted(used, begin)
        most = 2 * (ones[at + (end - begin)] - ones[at]) > (end - begin)[:, None]
        made[low : low + _WINDOWS] = np.packbits(most, axis=1).view(np.uint64).ravel()
    return made


class _Fingerprints:
    """Multi-index of the fingerprints of items of one size: per block, the items at most one bit from each value."""

    def __init__(self, items: np.ndarray, prints: np.ndarray) -> None:
        self.items, self.prints = items, prints
        turned = np.concatenate(([0], 1 << np.arange(8))).astype(np.uint8)
        self.blocks = []
        for block in prints.view(np.uint8).reshape(-1, BLOCKS).T:
            values = (block[:, None] ^ turned).ravel()
            order = np.argsort(values, kind="stable")
            self.blocks.append((np.searchsorted(values[order], np.arange(257)), order // len(turned)))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``prints`` and the items within RADIUS of them, each pair once. At most _PAIRS are looked at at a
        time, or those of one window."""
        found = [np.zeros(0, np.int64)]
        for values, (edges, members) in zip(prints.view(np.uint8).reshape(-1, BLOCKS).T, self.blocks):
            low, high = edges[values], edges[values.astype(np.int64) + 1]
            upto = np.cumsum(high - low)
            begin = 0
            while begin < len(prints):
                end = max(int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + _PAIRS, "right")), begin + 1)
                place = np.repeat(np.arange(begin, end), (high - low)[begin:end])
                item = members[_ranges(low[begin:end], high[begin:end] - 1)]
                near = np.bitwise_count(prints[place] ^ self.prints[item]) <= RADIUS
                found.append(place[near] * len(self.items) + item[near])
                begin = end
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.items), self.items[pairs % len(self.items)]


@dataclass
class _Item:
    id: int
    size: int
    shingles: np.ndarray


@dataclass
class Passages:
    """A bounded set of benchmark items, indexed by shingle and, for each size, by blocks of their fingerprints."""

    items: list[_Item] = field(default_factory=list)
    postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    sizes: np.ndarray | None = None
    prints: dict[int, _Fingerprints] = field(default_factory=dict)

    @staticmethod
    def of(ids: list, texts: list) -> Passages:
        made = Passages()
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        by_size: dict[int, list[int]] = {}
        for first, hashed, owner, n in _tokens(pa.array(texts, pa.large_string())):
            limits = np.searchsorted(owner, np.arange(n + 1))
            for i in range(n):
                own = hashed[limits[i] : limits[i + 1]]
                length = min(SHINGLE, len(own))
                if not length:
                    continue
                shingles = runs(own, np.zeros(len(own), np.int64), length, seed=4)[1]
                at = len(made.items)
                made.items.append(_Item(ids[first + i], len(own), shingles))
                by_length.setdefault(length, []).append((np.unique(shingles), at))
                by_size.setdefault(len(own), []).append(at)
        for length, rows in by_length.items():
            keys = np.concatenate([s for s, _ in rows])
            owners = np.concatenate([np.full(len(s), at) for s, at in rows])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
            seen[keys & np.uint64((1 << _FILTER_BITS) - 1)] = True
            made.postings[length] = (keys[order], owners[order], seen)
        made.sizes = np.array([item.size for item in made.items], np.int64)
        for size, at in by_size.items():
            of = [fingerprints(made.items[i].shingles, np.array([0]), np.array([len(made.items[i].shingles)])) for i in at]
            made.prints[size] = _Fingerprints(np.array(at), np.concatenate(of))
        return made

    def found_in(self, column: pa.Array, similarity: float) -> Iterator[tuple[int, int, float, int]]:
        """Row, item id, best similarity and first word of that window, for each row and item that reach it."""
        for first, hashed, owner, n in _tokens(column):
            limits = np.searchsorted(owner, np.arange(n + 1))
            for length, (keys, owners, seen) in self.postings.items():
                begins, shingles = runs(hashed, owner, length, seed=4)
                maybe = seen[shingles & np.uint64((1 << _FILTER_BITS) - 1)]
                at, probe = begins[maybe], shingles[maybe]
                low, high = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
                many = high - low
                if not many.sum():
                    continue
                where = np.repeat(at, many)
                item = owners[_ranges(low, high - 1)]
                text = owner[where]
                everything = np.zeros(len(hashed), np.uint64)
                everything[begins] = shingles
                windows: dict[tuple[int, int], list[np.ndarray]] = {}
                for t, i, starts in self.by_fingerprint(where, item, owner, limits, everything, length):
                    windows.setdefault((t, i), []).append(starts)
                hits = dict(_grouped(text, item, where))
                for (t, i), positions in hits.items():
                    starts = self._by_count(positions, i, limits[t], limits[t + 1], similarity)
                    if len(starts):
                        windows.setdefault((t, i), []).append(starts)
                for (t, i), starts in windows.items():
                    if (t, i) in hits:
                        best = self._best(np.unique(np.concatenate(starts)), hits[t, i], i, limits[t + 1], everything, length, similarity)
                        if best:
                            yield first + t, self.items[i].id, best[0], best[1] - int(limits[t])

    def by_fingerprint(self, where, item, owner, limits, shingles, length) -> Iterator[tuple[int, int, np.ndarray]]:
        """Text, item and first words of the windows whose fingerprints are within RADIUS of the item's.

        Of each size the windows are fingerprinted that hold a shingle of an item of that size; others share nothing.
        """
        size = self.sizes[item]
        for n in np.unique(size):
            hits = np.unique(where[size == n])
            wide = int(n) - length + 1
            starts = _ranges(np.maximum(hits - wide, np.concatenate(([-1], hits[:-1]))) + 1, hits)
            begin, end = limits[owner[starts]], limits[owner[starts] + 1]
            starts = starts[starts <= np.maximum(begin, end - n)]
            # A range that reaches into the text before holds starts of that text, of which no window needs more.
            end = limits[owner[starts] + 1] - length + 1
            ends = np.minimum(starts + wide, end)
            starts, ends = starts[ends > starts], ends[ends > starts]
            if len(starts):
                place, found = self.prints[int(n)].within(fingerprints(shingles, starts, ends))
                for (t, i), positions in _grouped(owner[starts[place]], found, starts[place]):
                    yield t, i, positions

    def _by_count(self, hits, i, begin, end, similarity) -> np.ndarray:
        """First words of the windows of item ``i``'s size with enough shared shingles to reach the similarity.

        Enough shared shingles are necessary for it. A fingerprint is not: a word repeated in a window pulls its
        majority, so these windows are verified too, however far their fingerprints are.
        """
        item = self.items[i]
        n = len(item.shingles)
        if len(hits) < similarity * n:
            return hits[:0]
        starts = np.arange(max(begin, hits[0] - n + 1), min(hits[-1], max(begin, end - item.size)) + 1)
        count = np.searchsorted(hits, starts + n, "left") - np.searchsorted(hits, starts, "left")
        return starts[count >= similarity * n]

    def _best(self, starts, hits, i, end, shingles, length, similarity):
        """The most similar of the windows of item ``i``'s size that begin at ``starts``, the first of equals."""
        item = self.items[i]
        n = len(item.shingles)
        count = np.searchsorted(hits, starts + n, "left") - np.searchsorted(hits, starts, "left")
        # No more than the shared shingles can be common to both: windows that can't beat the best are not compared.
        most = count / (n + np.minimum(n, end - length + 1 - starts) - count)
        best = None
        for at in np.lexsort((starts, -most)):
            start = int(starts[at])
            if most[at] < similarity or (best and (most[at] < best[0] or (most[at] == best[0] and start > best[1]))):
                continue
            value = weighted_similarity(shingles[start : min(start + n, end - length + 1)], item.shingles)
            if value >= similarity and (best is None or (value, -start) > (best[0], -best[1])):
                best = (value, start)
        return best


def _grouped(text: np.ndarray, item: np.ndarray, where: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Ordered places of each text and item."""
    order = np.lexsort((where, item, text))
    where, item, text = where[order], item[order], text[order]
    cuts = np.flatnonzero(np.diff(item) | np.diff(text)) + 1
    for low, high in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(where)]))):
        if high > low:
            yield (int(text[low]), int(item[low])), where[low:high]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger number of occurrences of each shingle."""
    keys, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    x = np.bincount(where[: len(a)], minlength=len(keys))
    y = np.bincount(where[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _passes(benchmark: DataFrame, id_column: str, text_column: str) -> tuple[int, Iterator[Passages]]:
    """The number of passes and, one at a time, what each looks for: only the items of one pass are on the driver."""
    rows = benchmark.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    parts = max(-(-size["n"] // ITEMS), -(-size["chars"] // ITEM_CHARS), 1)

    def each() -> Iterator[Passages]:
        for part in range(parts):
            own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).orderBy("id", "text").collect()
            yield Passages.of([row["id"] for row in own], [row["text"] for row in own])

    return parts, each()


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """``doc_id, item_id, similarity, first_word``: the best window of each document and item that reach ``similarity``.

    Words are runs of letters and digits of the lower-cased text; a window has as many words as the item, or is the
    whole document if that is shorter. Candidates are the windows whose SimHash is within RADIUS of the item's, all of
    which the Hamming blocks find, and those that share enough of the item's shingles (5 words; an item of fewer is one
    shingle) to reach the similarity, so that none is lost; the weighted Jaccard similarity of shingles with their
    repeats decides. Null and empty texts match nothing; repeated rows match alike; a null id stays null; empty tables
    give no rows. A benchmark beyond ITEMS takes several passes, each written before the next is prepared.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    found = None
    parts, passes = _passes(benchmark, item_column, item_text_column)
    for passages in passes:

        def search(batches: Iterator[pa.RecordBatch], passages: Passages = passages) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(passages.found_in(batch.column(1), similarity))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "item_id", "similarity", "first_word"])

        made = rows.mapInArrow(search, "doc_id long, item_id long, similarity double, first_word long")
        made = stored(made, "passages") if parts > 1 else made
        found = made if found is None else found.unionByName(made)
    return found


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which :func:`find_passages` finds nothing, unchanged.

    One pass is a filter, nothing is shuffled. Several passes write the digests of the texts they find, and equal texts
    go with them.
    """
    bound_batches(docs.sparkSession)
    parts, passes = _passes(benchmark, item_column, item_text_column)
    text, found = F.col(f"`{text_column}`"), None
    for passages in passes:

        @arrow_udf("boolean")
        def dirty(text: pa.Array) -> pa.Array:
            hit = np.zeros(len(text), dtype=bool)
            hit[[row for row, *_ in passages.found_in(text, similarity)]] = True
            return pa.array(hit)

        if parts == 1:
            return docs.where(~dirty(text))
        made = stored(docs.where(dirty(text)).select(F.sha2(text, 256).alias("digest")), "contaminated")
        found = made if found is None else found.unionByName(made)
    digests = broadcast_if_small(found.distinct()).alias("_found")
    return docs.join(digests, F.sha2(text, 256) == F.col("_found.digest"), "left_anti")
