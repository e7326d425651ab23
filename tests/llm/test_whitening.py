"""Rank-one updates and whitening against plain eigendecompositions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from panelworks.llm import folding, whitening
from panelworks.llm.queries import QUERIES
from panelworks.llm.secular import Spectrum, rank_one
from tests.llm.conftest import CLASHING

EXTRA = [*CLASHING, "vector", "place", "count", "size", "whitened"]
SCHEMA = "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` string" for c in EXTRA)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 1.0 + 1e-15, 2.0, 1e-9, 1e6]), min_size=1, max_size=8), st.integers(0, 99))
def test_rank_one_with_equal_values_and_zeros(values, seed):
    rng = np.random.default_rng(seed)
    n = len(values)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    x = q @ (rng.normal(size=n) * rng.integers(0, 2, n) * 10.0 ** rng.integers(-9, 4, n))
    got, vectors = rank_one(np.array(values), q, x)
    whole = q * np.array(values) @ q.T + np.outer(x, x)
    size = max(np.abs(whole).max(), 1e-300)
    assert np.abs(vectors * got @ vectors.T - whole).max() < 1e-13 * n * size
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    assert np.abs(np.sort(got) - np.linalg.eigvalsh(whole)).max() < 1e-13 * n * size


def test_adding_and_merging_give_the_scatter():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(90, 12)) * 8)
    x[:, 3] = x[:, 4]
    parts = [Spectrum.empty(12) for _ in range(4)]
    for i, row in enumerate(x):
        parts[i % 3].add(row)
    parts[3].add(x[0], 7)
    whole = Spectrum.empty(12)
    for part in parts:
        whole.merge(Spectrum.from_bytes(part.to_bytes(), 12))
    every = np.vstack((x, np.repeat(x[:1], 7, axis=0)))
    centred = every - every.mean(axis=0)
    assert whole.count == 97 and np.allclose(whole.mean, every.mean(axis=0), atol=1e-12)
    assert np.abs(whole.vectors * whole.values @ whole.vectors.T - centred.T @ centred).max() < 1e-9


def expected(vectors, most=32):
    x = np.floor(np.array(vectors, dtype=np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:most]
    return n, ((n * x - total) ** 2).sum(axis=1), centred @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def check(rows, vectors, most=32):
    n, deviation, white, share = expected(vectors, most)
    got = np.array([r.whitened for r in rows])
    assert [r.deviation for r in rows] == deviation.tolist() and {r.n for r in rows} == {n}
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-9
    assert np.allclose(rows[0].explained, share, rtol=1e-10) and max(r.identity_error for r in rows) < 1e-10


def hard_vectors(size=40, rows=230):
    rng = np.random.default_rng(2)
    good = [list(map(float, v)) for v in rng.normal(size=(rows, size)) * np.linspace(0.1, 2, size)] + [[0.25] * size] * 60
    bad = [None, [], [None] * size, [1.0] * (size - 1) + [math.nan], [1.0] * (size - 1) + [-math.inf], [1.0] * 3, [1.0] * 3]
    return good, bad


def test_whitening_on_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(folding, "FAN_IN", 2)
    good, bad = hard_vectors()
    rows = [(i if i else None, v, *EXTRA) for i, v in enumerate(good + bad)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = whitening.whiten(table).collect()
    assert sorted(r.vec_id or 0 for r in got) == list(range(len(good)))
    check(sorted(got, key=lambda r: r.vec_id or 0), good)
    assert whitening.components_of(whitening.whiten(table)).count() == 32 * len(good)


@pytest.mark.parametrize("vectors", [[[0.5, 1.5]] * 9, [[1.0, 2.0]]])
def test_without_variance(spark, vectors):
    got = whitening.whiten(spark.createDataFrame([(i, v, *EXTRA) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert {(r.n, r.deviation, tuple(r.whitened), r.identity_error) for r in got} == {(len(vectors), 0, (), 0.0)}


def test_few_directions_huge_entries_and_empty_tables(spark):
    line = [[float(i), 2.0 * i, 0.0] for i in range(20)]
    got = whitening.whiten(spark.createDataFrame([(i, v, *EXTRA) for i, v in enumerate(line)], SCHEMA)).collect()
    assert all(len(r.whitened) == 1 for r in got) and abs(got[0].explained[0] - 1) < 1e-12
    far = [[1e15, 0.0], [-1e15, 1.0], [3e15, 2.0], [1e30, 1.0]]
    huge = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame([(i, v, *EXTRA) for i, v in enumerate(far)], SCHEMA)).collect()}
    assert set(huge) == {0, 1, 2} and all(r.deviation is None and r.n == 3 for r in huge.values())
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).count() == whitening.components_of(whitening.whiten(none)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, *EXTRA)], SCHEMA)).count() == 0


def test_query_against_plain_whitening(spark, sf_dir):
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    good = {i: v for i, v in table.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    got = QUERIES["op12_embedding_whitening"](spark, sf_dir).toPandas()
    n, deviation, white, share = expected(list(good.values()))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[list(good)].to_numpy()
    assert wide.shape == white.shape and np.abs(wide * np.sign((wide * white).sum(axis=0)) - white).max() < 1e-8
    assert (got.drop_duplicates("vec_id").set_index("vec_id").deviation.loc[list(good)].to_numpy() == deviation).all()
    assert got.n.eq(n).all() and got.identity_error.max() < 1e-9
