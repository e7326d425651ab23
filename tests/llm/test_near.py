"""Near duplicates, decontamination and repeats against brute force over hard rows."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelworks.llm import components, decontaminate, jaccard, repeats, suffixes, words
from panelworks.llm.columns import insert_columns
from panelworks.llm.rtree import CountTree, needed
from tests.llm.conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def key(row):
    return row.doc_id if row.doc_id is not None else float("-inf")


def brute_components(rows, length, percent):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(w[i : i + length]) for i in range(len(w) - length + 1)} or ({tuple(w)} if w else set()))
    label = [key(r) for r in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                same = key(rows[i]) == key(rows[j])
                if (same or (a and 100 * len(a & b) >= percent * len(a | b))) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return Counter((r.doc_id, len(s), None if l == float("-inf") else l) for r, s, l in zip(rows, sets, label))


@pytest.mark.parametrize("length, percent", [(3, 90), (5, 80)])
def test_components_match_brute_force(hard, length, percent):
    got = jaccard.near_duplicates(hard, length, percent).collect()
    assert Counter(map(tuple, got)) == brute_components(hard.collect(), length, percent)


def test_dense_group_of_near_copies_and_chains(spark):
    """Copies of one text that each miss another word, a chain whose ends differ, and sharers of a line."""
    words = prose(20, 120).split()
    texts = [" ".join(words[:i] + words[i + 1 :]) for i in range(60)]
    chain = [" ".join(prose(30 + j, 1) if j < k else w for j, w in enumerate(words[60:])) for k in range(0, 40, 1)]
    texts += chain + [prose(200 + i, 6) + " a line that all of these have in common today" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.near_duplicates(rows, 3, 90).collect()
    assert Counter(map(tuple, got)) == brute_components(rows.collect(), 3, 90)


def test_keep_one_of_each_keeps_columns(hard):
    kept = jaccard.keep_one_of_each(hard)
    assert kept.columns == hard.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in jaccard.near_duplicates(hard).where("doc_id <=> component_id").collect()}


def test_blocks_of_a_large_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = np.random.default_rng(4)
    vectors = rng.integers(0, 6, (30, jaccard.GROUPS)).astype(np.int32)
    vectors[::5] *= 300
    rows = [(1, i, int(v.sum()), 0, i % 25) for i, v in enumerate(vectors)]
    members = spark.createDataFrame(rows, "key long, id long, n long, place long, label long")
    blobs = [(r[1], r[2], bytearray(v)) for r, v in zip(rows, jaccard._narrow(vectors))]
    points = spark.createDataFrame(blobs, "id long, n long, vector binary")
    got = {tuple(r) for r in jaccard._candidates(members, points, 60).collect()}
    assert got == brute_pairs(vectors, [r[2] for r in rows], [r[4] for r in rows], 60)


def brute_pairs(vectors, sizes, labels, percent):
    return {
        (i, j)
        for i in range(len(vectors))
        for j in range(i + 1, len(vectors))
        if labels[i] != labels[j] and np.minimum(vectors[i], vectors[j]).sum() >= -(-percent * (sizes[i] + sizes[j]) // (100 + percent))
    }


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    vectors = rng.poisson(4, (400, 16)) + rng.integers(0, 9, (400, 1))
    sizes, labels = vectors.sum(axis=1), rng.integers(0, 50, 400)
    q, p = CountTree(vectors, sizes, labels).search(vectors, sizes, labels, 75)
    got = {(min(a, b), max(a, b)) for a, b in zip(q.tolist(), p.tolist()) if a != b}
    assert got == brute_pairs(vectors, sizes, labels, 75)
    assert needed(np.array([10]), np.array([10]), 90)[0] == 10


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 50, 50: 50}


def benchmark_rows():
    return [(1, prose(2, 60)), (2, "one two"), (3, None), (4, ""), (5, prose(1, 300)[200:500]), (6, "na " * 40), (None, prose(90, 20))]


def tokens(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute_passages(docs, items):
    found = {}
    for d in docs:
        w = tokens(d.text)
        for item, text in items:
            v = tokens(text)
            k = min(5, len(v))
            if not v:
                continue
            grams = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
            c, best = grams(v), 0
            for a in range(max(1, len(w) - len(v) + 1)):
                b = grams(w[a : a + len(v)])
                if b:
                    best = max(best, sum((b & c).values()) / sum((b | c).values()))
            if best >= 0.8:
                found.setdefault((d.doc_id, item), []).append(round(best, 9))
    return {k: sorted(v) for k, v in found.items()}


def test_passages_match_brute_force(spark, hard, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    bench = spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    got = {}
    for r in decontaminate.find_passages(hard, bench).collect():
        got.setdefault((r.doc_id, r.item_id), []).append(round(r.similarity, 9))
    small = [r for r in hard.collect() if len(r.text or "") < 100_000]
    expected = brute_passages(small, benchmark_rows())
    assert {k: sorted(v) for k, v in got.items()} == expected and len(expected) > 5
    clean = decontaminate.drop_contaminated(hard, bench)
    assert clean.columns == hard.columns
    monkeypatch.setattr(decontaminate, "ITEMS", 1000)
    one_pass = decontaminate.drop_contaminated(hard, bench)
    assert Counter(map(tuple, one_pass.collect())) == Counter(map(tuple, clean.collect()))
    assert clean.count() == hard.count() - sum(
        1 for r in hard.collect() if len(r.text or "") < 100_000 and brute_passages([r], benchmark_rows())
    )


def test_passages_before_a_repeated_word(spark):
    items = [(i, prose(300 + i, words)) for i, words in enumerate([404, 404, 404, 204, 204, 204, 104, 104])]
    docs = [(i, " ".join([*text.split()[: int(part * len(text.split()))], *["filler"] * 500])) for i, text in items for part in (0.91, 0.95)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in decontaminate.find_passages(frame, spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault((r.doc_id, r.item_id), []).append(round(r.similarity, 9))
    expected = brute_passages(frame.collect(), items)
    assert {k: sorted(v) for k, v in got.items()} == expected and sum(map(len, expected.values())) == len(docs)


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 1 << 63, 300, np.uint64)
    probes = []
    for _ in range(2000):
        turned = rng.choice(64, rng.integers(0, 30), replace=False)
        probes.append(prints[rng.integers(300)] ^ np.bitwise_or.reduce(np.uint64(1) << turned.astype(np.uint64), initial=np.uint64(0)))
    probes = np.array(probes)
    places, items = decontaminate._Fingerprints(np.arange(300) * 7, prints).within(probes)
    expected = {(i, 7 * j) for i, a in enumerate(probes) for j, b in enumerate(prints) if int(a ^ b).bit_count() <= decontaminate.RADIUS}
    assert list(zip(places.tolist(), items.tolist())) == sorted(expected) and len(expected) > 900


def test_fingerprints_are_majorities_of_bits():
    rng = np.random.default_rng(9)
    shingles = rng.integers(0, 1 << 63, 400, np.uint64)
    starts = np.sort(rng.choice(380, 120, replace=False))
    ends = np.minimum(starts + 15, 390)
    for got, low, high in zip(decontaminate.fingerprints(shingles, starts, ends), starts, ends):
        bits = np.unpackbits(decontaminate.scramble(shingles[low:high]).view(np.uint8).reshape(-1, 8), axis=1)
        assert np.packbits(2 * bits.sum(axis=0) > high - low).view(np.uint64)[0] == got


def test_fingerprints_alone_find_nine_of_ten_passages(monkeypatch):
    """Passages with every 55th word replaced, without the candidates that shared shingles give."""
    items = [(i, prose(500 + i, 60 + 5 * (i % 30))) for i in range(150)]
    texts = []
    for i, text in items:
        w = text.split()
        for at in range(30, len(w), 55):
            w[at] = "other"
        texts.append(" ".join([prose(900 + i, 150), *w, prose(1200 + i, 90)]))
    passages = decontaminate.Passages.of([i for i, _ in items], [t for _, t in items])
    column = pa.array(texts)
    every = {(row, item) for row, item, *_ in passages.found_in(column, 0.8)}
    monkeypatch.setattr(decontaminate.Passages, "_by_count", lambda self, hits, *_: hits[:0])
    alone = {(row, item) for row, item, *_ in passages.found_in(column, 0.8)}
    assert alone <= every and len(every) > 100 and len(alone) >= 0.9 * len(every)


def test_removed_words_match_brute_force(hard):
    rows = sorted(hard.collect(), key=key)
    first = {}
    tokens_of = [WORD.findall(r.text or "") for r in rows]
    for r, w in zip(rows, tokens_of):
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (key(r), i))
    expected = Counter()
    for r, w in zip(rows, tokens_of):
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (key(r), i):
                gone.update(range(i, i + 20))
        expected[r.doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    assert Counter(map(tuple, repeats.without_repeats(hard).collect())) == expected
    assert sum(n for _, _, n, _ in expected) > 500


def test_removed_bytes_match_brute_force(hard, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 1 << 14)
    rows = sorted(hard.collect(), key=key)
    first = {}
    for r in rows:
        w = (r.text or "").encode()
        for i in range(len(w) - 99):
            first.setdefault(w[i : i + 100], (key(r), i))
    expected = Counter()
    for r in rows:
        w = (r.text or "").encode()
        gone = bytearray(len(w))
        for i in range(len(w) - 99):
            if first[w[i : i + 100]] != (key(r), i):
                gone[i : i + 100] = b"\1" * 100
        spans = len(re.findall(b"\1+", bytes(gone)))
        left = bytes(b for b, g in zip(w, gone) if not g)
        expected[r.doc_id, len(w), sum(gone), spans, hashlib.sha256(left).hexdigest()] += 1
    got = suffixes.without_repeated_strings(hard).collect()
    assert Counter((*r[:4], hashlib.sha256(r.kept).hexdigest()) for r in got) == expected
    assert sum(s for *_, s, _ in expected) > 5


def test_column_sort_gives_order_and_common_prefixes():
    rng = np.random.default_rng(5)
    rows = rng.integers(1, 3, (50, 12)).astype(np.uint16)
    rows[rng.random(50) < 0.2, 8:] = 0
    for column, order, common in insert_columns(rows):
        tails = [tuple(rows[i, column:]) for i in order]
        assert tails == sorted(tails)
        for (a, b), n in zip(zip(tails, tails[1:]), common[1:]):
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y or x == 0), len(a))
            assert n == same


def test_empty_tables(spark, none):
    bench = spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    assert jaccard.near_duplicates(none).count() == jaccard.keep_one_of_each(none).count() == 0
    assert decontaminate.find_passages(none, bench).count() == decontaminate.drop_contaminated(none, bench).count() == 0
    assert decontaminate.find_passages(bench.withColumnRenamed("item_id", "doc_id"), bench.limit(0)).count() == 0
    assert repeats.without_repeats(none).count() == suffixes.without_repeated_strings(none).count() == 0


def test_fingerprints_within_the_radius_are_found_however_few_pairs_are_looked_at(monkeypatch):
    rng = np.random.default_rng(5)
    items = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    turned = np.array([sum(1 << int(b) for b in rng.choice(64, n % 20, replace=False)) for n in range(300)], np.uint64)
    prints = items[np.arange(300) % 40] ^ turned
    index = decontaminate._Fingerprints(np.arange(100, 140), items)
    want = {(p, 100 + i) for p in range(300) for i in range(40) if int(prints[p] ^ items[i]).bit_count() <= decontaminate.RADIUS}
    for pairs in (1, 50, 1 << 19):
        monkeypatch.setattr(decontaminate, "_PAIRS", pairs)
        assert set(zip(*(x.tolist() for x in index.within(prints)))) == want
    assert [len(x) for x in index.within(prints[:0])] == [0, 0]


def test_sets_of_many_texts_take_little_memory():
    texts = pa.array([prose(i, 2000) for i in range(300)], pa.string())
    words._POWERS.clear()
    tracemalloc.start()
    whole = [s[a:b].tobytes() for _, s, limits in jaccard._sets(texts, 5) for a, b in zip(limits[:-1], limits[1:])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    alone = [s.tobytes() for text in texts for _, s, _ in jaccard._sets(pa.array([text]), 5)]
    assert whole == alone
