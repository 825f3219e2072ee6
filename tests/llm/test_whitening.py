import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frostline.llm import whitening
from frostline.llm.queries import QUERIES

from .test_dedup import SF

SCHEMA = "vec_id long, embedding array<float>, x string, n int, _id int"


def whole(vectors):
    return np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000


def by_hand(x):
    """n, sums, eigenvalues falling, eigenvectors as columns, and the trace, of the distinct rows of x."""
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov((fit - 1_000_000).T, bias=True).reshape(x.shape[1], -1))
    return len(fit), fit.sum(axis=0), values[::-1], vectors[:, ::-1], values.sum()


@given(st.integers(1, 24), st.integers(0, 10**6), st.booleans())
@settings(max_examples=80, deadline=None)
def test_eigen_solve(d, seed, poor):
    a = np.random.default_rng(seed).normal(size=(d, max(1, d // 2) if poor else d + 3))
    m = a @ a.T
    values, rows = whitening.eigen(m)
    scale = max(1.0, np.abs(m).max())
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-11 * scale)
    assert np.allclose(rows @ rows.T, np.eye(d), atol=1e-11) and np.allclose(rows @ m, values[:, None] * rows, atol=1e-10 * scale)


def test_eigen_of_flat_matrices():
    for m in (np.zeros((5, 5)), np.eye(4), np.ones((6, 6)), np.diag([3.0, 3.0, 1.0]), np.zeros((0, 0))):
        values, rows = whitening.eigen(m)
        assert np.allclose(rows.T * values @ rows, m)


@given(st.lists(st.lists(st.integers(-10**6, 10**6), min_size=3, max_size=3), min_size=1, max_size=30), st.integers(0, 29))
@settings(max_examples=60, deadline=None)
def test_merged_states_are_those_of_one_pass(rows, cut):
    x = np.array(rows, float)
    parts = []
    for part in (x[:cut], x[cut:]):
        state = whitening.Moments.empty(3)
        for v in part:
            state.add(v)
        parts.append(state)
    parts[0].merge(parts[1])
    assert parts[0].n == len(x) and np.allclose(parts[0].mean, x.mean(axis=0), atol=1e-6)
    assert np.allclose(parts[0].covariance(), np.cov(x.T, bias=True), rtol=1e-9, atol=1e-3)


def check(rows, vectors, ids):
    x = whole(vectors)
    n, sums, values, axes, trace = by_hand(x)
    k = len(rows[0].whitened)
    got = {r.vec_id: r for r in rows}
    want = (x - sums / n) @ axes[:, :k] / np.sqrt(values[:k])
    mine = np.array([got[i].whitened for i in ids])
    signs = np.sign((mine * want).sum(axis=0))
    assert np.allclose(mine * signs, want, atol=1e-7)
    for i, v in zip(ids, x.tolist(), strict=True):
        r = got[i]
        assert r.n == n and int(r.deviation) == sum((n * a - int(s)) ** 2 for a, s in zip(v, sums, strict=True))
        assert np.allclose(r.explained, values[:k] / trace, rtol=1e-9) and r.identity_error < 1e-9


def test_query_against_numpy(spark):
    rows = QUERIES["op12_embedding_whitening"](spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = whole(np.stack(table.embedding))
    n, sums, values, axes, trace = by_hand(x)
    assert len(rows) == 16 * len(table) and (rows.n == n).all() and rows.identity_error.max() < 1e-9
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    want = (x - sums / n) @ axes[:, :16] / np.sqrt(values[:16])
    assert np.allclose(wide * np.sign((wide * want).sum(axis=0)), want, atol=1e-7)
    assert np.allclose(rows.groupby("component").explained.max(), values[:16] / trace)
    deviation = dict(zip(table.vec_id, ((n * x - sums) ** 2).sum(axis=1).tolist(), strict=True))
    assert all(deviation[r.vec_id] == r.deviation for r in rows.itertuples())


def test_copies_count_once_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(40, 5)).astype(np.float32).tolist()
    rows = [(i, vectors[i % 40 if i < 80 else 0], "x", 1, 2) for i in range(200)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 200
    check(got, [r[1] for r in rows], [r[0] for r in rows])


def test_rows_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, v, None, 1, 1) for i, v in enumerate([[1.0, 2.0], [0.5, -1.0], [3.25, 0.0], [1.0, 2.0], [-2.0, 7.0]])]
    bad = [(10, None, "x", 1, 1), (11, [1.0, None], "x", 1, 1), (12, [nan, 1.0], "x", 1, 1), (13, [1.0, -inf], "x", 1, 1), (14, [1e30, 1.0], "x", 1, 1)]
    other = [(20, [], "x", 1, 1), (21, [4.0], "x", 1, 1), (22, [4.0], "x", 1, 1), (None, [1.0, 0.0, 0.0], "x", 1, 1), (24, [2.0, 0.0, 0.0], "x", 1, 1)]
    rows = whitening.whiten(spark.createDataFrame(good + bad + other, SCHEMA)).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2, 3, 4, 20, 21, 22, None, 24}
    check([r for r in rows if r.vec_id is not None and r.vec_id < 10], [g[1] for g in good], [g[0] for g in good])
    found = {r.vec_id: r for r in rows}
    assert found[20].whitened == [] and found[20].n == 1 and found[21].whitened == [] and found[21].n == 1 and found[21].deviation == 0
    assert sorted(found[i].whitened[0] for i in (None, 24)) == pytest.approx([-1, 1]) and found[24].explained == pytest.approx([1.0])


def test_large_numbers_stay_exact(spark):
    vectors = [[1e15, 2.0], [-1e15, 3.0], [3e14, -9.0]]
    rows = spark.createDataFrame([(i, v, "x", 1, 1) for i, v in enumerate(vectors)], SCHEMA.replace("float", "double"))
    x = [[int(64 * c) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in whitening.whiten(rows).collect():
        assert int(r.deviation) == sum((3 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))


def test_too_many_dimensions_are_an_error(spark):
    with pytest.raises(ValueError, match="most_dimensions"):
        whitening.whiten(spark.createDataFrame([(1, [1.0] * 9, "x", 1, 1)], SCHEMA), most_dimensions=8)


def test_nothing(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
