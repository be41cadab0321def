"""Whitening against an eigendecomposition and whole-number sums, on plain and odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import whitening
from riskspark.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def brute(vectors, k=4):
    """{index of vector: (deviation, [whitened], [explained])} by exact sums and numpy's eigh."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in vectors.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums).astype(float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:k]
    order = order[e[order] > 1e-9 * max(e.max(), 1e-300)]
    out = {}
    for i, v in x.items():
        off = np.array(v, object) * n - sums
        w = off.astype(float) / n @ u[:, order] / np.sqrt(e[order])
        out[i] = (int((off * off).sum()), w, e[order] / e.sum())
    return n, out


def compare(rows, vectors, k=4):
    n, want = brute(vectors, k)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(want)
    signs = None
    for i, (deviation, w, explained) in want.items():
        mine = [got[i][c + 1] for c in range(len(w))]
        assert len(got[i]) == len(w)
        assert all(r["n"] == n and r["deviation"] == deviation and r["identity_error"] < 1e-9 for r in mine)
        values = np.array([r["whitened"] for r in mine])
        if signs is None and (np.abs(w) > 1e-6).all():
            signs = np.sign(values * w)
        assert np.allclose(np.abs(values), np.abs(w), rtol=1e-7, atol=1e-7)
        if signs is not None:
            assert np.allclose(values, w * signs, rtol=1e-7, atol=1e-7)
        assert np.allclose([r["explained"] for r in mine], explained, rtol=1e-9)


def flat(df):
    return df.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()


def test_whole_table(spark):
    rows = whitening.op12(spark, FOLDER).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in table(spark, FOLDER, "embeddings").collect()}
    compare(rows, vectors)
    assert len(rows) == 4 * len(vectors)


def test_odd_rows(spark):
    generator = np.random.default_rng(3)
    basis = generator.normal(size=(3, 9))
    good = {i: (generator.normal(size=3) @ basis).astype(np.float32).tolist() for i in range(40)}
    copies = {100 + i: good[5] for i in range(20)}  # a third are one vector
    bad = [
        (200, None), (201, [None] + [1.0] * 8), (202, [float("nan")] + [1.0] * 8), (203, [float("inf")] * 9),
        (204, [1.0, 2.0]), (205, []),
    ]
    rows = [*{**good, **copies}.items(), *bad]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, component string")
    df = df.withColumns({"x": F.lit(1), "d": F.lit("d"), "n": F.lit(None).cast("long")}).repartition(5)
    got = flat(whitening.whiten(df, "embedding", ["vec_id", "component", "x", "d", "n"]))
    compare(got, {**good, **copies})


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]])
def test_no_component(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert flat(whitening.whiten(df, "embedding", ["vec_id"])) == []


def test_few_components_null_ids_and_repeats(spark):
    """Two distinct vectors have one direction; rows stay as often as they come."""
    rows = [(None, [0.0, 1.0, 0.0]), (7, [1.0, -1.0, 0.0]), (7, [1.0, -1.0, 0.0])]
    got = flat(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "embedding", ["vec_id"]))
    assert sorted((r["vec_id"] or 0, r["component"], round(abs(r["whitened"]), 9)) for r in got) == [(0, 1, 1.0), (7, 1, 1.0), (7, 1, 1.0)]
    assert {r["n"] for r in got} == {2} and {round(r["explained"], 12) for r in got} == {1.0}


def test_wide_numbers(spark):
    """Sums beyond the long range stay exact; a deviation beyond it is null."""
    rows = {i: [float(2**30 * (i % 5)), float(-(2**33) * (i % 3)), 0.25 * i] for i in range(30)}
    got = flat(whitening.whiten(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>"), "embedding", ["vec_id"]))
    n, want = brute(rows)
    assert {r["n"] for r in got} == {n}
    for r in got:
        deviation = want[r["vec_id"]][0]
        assert r["deviation"] == (deviation if deviation < 2**63 else None)
    assert max(r["identity_error"] for r in got) < 1e-6


def test_cholesky_and_jacobi():
    generator = np.random.default_rng(1)
    for d, rank in [(1, 1), (5, 5), (8, 3), (33, 33), (20, 1)]:
        a = generator.normal(size=(d, rank)) * 10.0 ** -generator.integers(0, 4, rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v, atol=1e-12 * v.max())
        values, units = whitening.one_sided_jacobi(factor)
        assert np.allclose(units.T @ units, np.eye(rank), atol=1e-12)
        assert np.allclose(units * values @ units.T, v, atol=1e-12 * v.max())
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9, atol=1e-13 * v.max())
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
