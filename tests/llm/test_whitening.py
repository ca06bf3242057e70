"""Whitening against NumPy and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "other") for i, v in vectors], SCHEMA).repartition(3)


def exact_x(v, d):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (d - len(v))


def check(spark, vectors, components=32, **options):
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in good)
    x = [exact_x(v, d) for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    rows = wh.valid_rows(table(spark, vectors))
    model = wh.fit(rows, components, **options)
    assert (model.n, model.total) == (n, s)
    centred = np.array([[(n * c - t) / n for c, t in zip(r, s, strict=True)] for r in x])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    k = len(model.values)
    assert k == min(components, int((values > 1e-12 * values.sum()).sum()))
    assert model.values == pytest.approx(values[:k], rel=1e-9) and model.trace == pytest.approx(values.sum(), rel=1e-12)
    assert np.linalg.norm(cov @ model.vectors - model.vectors * model.values, axis=0).max() <= 1e-10 * values[0]
    found = wh.whiten(rows, model).collect()
    expected = {}
    for (i, _), r, c in zip(good, x, centred, strict=True):
        expected.setdefault(i, []).append((sum((n * a - t) ** 2 for a, t in zip(r, s, strict=True)), c @ (model.vectors / np.sqrt(model.values))))
    assert sorted(str(r.vec_id) for r in found) == sorted(str(i) for i, _ in good)
    for r in found:
        assert any((r.deviation == dev or dev >= 1 << 63 and r.deviation is None) and np.allclose(r.whitened, w, atol=1e-9) for dev, w in expected[r.vec_id])
    assert wh.identity_error(rows, model) <= 1e-8
    return model


def test_flat_spectrum_expands_to_the_full_dimension(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 0.2, 60).tolist()) for i in range(700)]
    vectors += [(900, None), (901, [float("nan")] * 60), (902, [0.1] * 59 + [None]), (903, [float("inf")] + [0.0] * 59), (5, vectors[5][1]), (None, vectors[7][1]), (910, [0.5] * 10), (911, [])]
    assert check(spark, vectors).basis == 60


def test_steep_spectrum_settles_in_the_sketch(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (900, 80)) * 8.0 * 2.0 ** (-1.2 * np.arange(80))
    vectors = list(enumerate((base @ np.linalg.qr(rng.normal(size=(80, 80)))[0]).tolist()))
    assert check(spark, vectors, components=4, oversample=12, power_passes=8, tolerance=1e-9).basis == 16


def test_columns_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK_BYTES", 8 * 50 * 7)
    rng = np.random.default_rng(5)
    check(spark, [(i, rng.normal(0, 0.2, 50).tolist()) for i in range(120)], power_passes=0)


def test_few_dimensions_large_entries_and_rows_without_variance(spark):
    assert len(check(spark, [(1, [3e9, 1.0]), (2, [-3e9, 2.0]), (3, [0.0, 2.5])]).values) == 1  # the second dimension is below 1e-12 of the trace
    check(spark, [(i, [i * 0.1, -i * 0.3, (i % 3) * 1.0]) for i in range(40)])
    rows = wh.valid_rows(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])]))
    assert len(wh.fit(rows).values) == 0
    assert len(wh.fit(rows.filter("vec_id < 0")).values) == 0
    assert len(wh.fit(wh.valid_rows(table(spark, [(1, [])]))).values) == 0
    assert wh.valid_rows(table(spark, [(1, [3e38])])).count() == 0


def test_query(spark, tmp_path):
    rng = np.random.default_rng(6)
    table(spark, [(i, rng.normal(0, 0.2, 40).tolist()) for i in range(90)] + [(None, [0.25] * 40)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = wh.op13_randomised_whitening(spark, str(tmp_path))
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert got.count() == 91 * 32 and got.agg(F.max("identity_error")).first()[0] < 1e-10
    table(spark, []).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert wh.op13_randomised_whitening(spark, f"{tmp_path}/none").count() == 0
