"""Two tokenizers aligned: against a plain loop over bytes, with the tokenizers' own libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelworks.llm import alignment, perfect, tokens
from panelworks.llm.queries import QUERIES
from panelworks.llm.words import scramble
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(f"{tokens.FOLDER}/{tokens.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{tokens.FOLDER}/{tokens.PIECE_BPE}")


def plain_tokens(text, libraries):
    a, b = libraries
    if not text:
        return [], [], [], []
    letters = tokens.byte_letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelt_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    spelt_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    return (ids_a, ids_b, spelt_a, spelt_b) if b"".join(spelt_a) == whole == b"".join(spelt_b) else ([], [], [], [])


def plain(rows, libraries):
    """Links byte by byte; counts over all rows."""
    every, counts = [], Counter()
    for doc, text in rows:
        ids_a, ids_b, spelt_a, spelt_b = plain_tokens(text, libraries)
        of_a = [i for i, t in enumerate(spelt_a) for _ in t]
        of_b = [i for i, t in enumerate(spelt_b) for _ in t]
        links = sorted(set(zip(of_a, of_b)))
        groups, a_part, b_part, left, right = [], [], [], 0, 0
        i = j = 0
        while i < len(spelt_a) or j < len(spelt_b):
            if left <= right and i < len(spelt_a) and (left < right or not a_part):
                a_part.append(ids_a[i])
                left += len(spelt_a[i])
                i += 1
            else:
                b_part.append(ids_b[j])
                right += len(spelt_b[j])
                j += 1
            if left == right and a_part and b_part:
                groups.append((a_part, b_part))
                a_part, b_part = [], []
        pairs = [(ids_a[x], ids_b[y]) for x, y in links]
        counts.update(pairs)
        every.append((doc, ids_a, ids_b, groups, pairs))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (
            doc,
            len(ids_a),
            len(ids_b),
            len(groups),
            len(pairs),
            sum(counts[p] == best[p[1]] for p in pairs),
            sum(counts[p] for p in pairs),
            ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups),
        )
        for doc, ids_a, ids_b, groups, pairs in every
    ]


STRANGE = [
    "<|endoftext|> a<|endoftext|>", "<s> </s> <unk> <0x41>", "a▁b", "  two  spaces \t\r\n\x00\x01", "né ﬁ Ⅷ \u3000ＡＢ ़ 👩‍👩‍👧 \ufeff", "e\u0301",
    "it's we'll I'd", "1234567 89", " ", "\n\n\n", "Größe ÉCOLE naïve ß " * 30, "日本語のテキスト", "a" * 30_000, " " * 20_000, "x",
]


@pytest.mark.parametrize("at_once", [alignment.AT_ONCE, 300])
def test_hard_rows_against_bytes(spark, hard, libraries, monkeypatch, at_once):
    monkeypatch.setattr(perfect, "PER_BUCKET", 64)
    monkeypatch.setattr(alignment, "_TOKENS", 2_000)
    schema = hard.schema["doc_id"].dataType
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(STRANGE)], f"doc_id {schema.simpleString()}, text string")
    docs = hard.unionByName(extra, allowMissingColumns=True).repartition(5)
    want = plain([(r.doc_id, r.text) for r in docs.collect()], libraries)
    got = alignment.align(docs, at_once=at_once)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(w[1] == 0 for w in want) >= 4 and any(0 < w[5] < w[4] for w in want)


def test_empty_tables(spark, none):
    assert alignment.align(none).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.align(nothing).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_encoder_agrees_with_the_vocabulary_file(libraries):
    texts = STRANGE[:12] + [prose(i, 400) for i in range(5)] + ["".join(chr(c) for c in range(i, i + 200)) for i in range(32, 0xD000, 977)]
    coder = tokens.Coder(tokens.read_vocabularies())
    for text, (a, b) in zip(texts, coder.encode(texts)):
        ids_a, ids_b, *_ = plain_tokens(text, libraries)
        assert a.tolist() == ids_a and b.tolist() == ids_b


@pytest.mark.parametrize("n", [0, 1, 2, 5_000])
def test_perfect_hash_is_minimal_and_verified(spark, monkeypatch, n):
    monkeypatch.setattr(perfect, "PER_BUCKET", 256)
    keys = np.unique(scramble(np.arange(n, dtype=np.uint64)) >> np.uint64(1))
    table = spark.createDataFrame([(int(k),) for k in keys], "key long")
    known = perfect.PerfectHash(perfect.build(table, len(keys)).collect())
    assert sorted(known.index(keys).tolist()) == list(range(len(keys)))
    assert (known.keys[known.index(keys)] == keys).all()
    others = np.setdiff1d(scramble(np.arange(n, 2 * n + 50, dtype=np.uint64)) >> np.uint64(1), keys)
    assert (known.index(others) == -1).all()


def test_query_on_given_documents(spark, sf_dir, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[1] else "") for w in plain(rows, libraries)]
    assert sorted(map(tuple, QUERIES["op11_token_alignment"](spark, sf_dir).collect())) == sorted(want)
