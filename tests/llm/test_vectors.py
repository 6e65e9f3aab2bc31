"""Whitening and the impact index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from workloom.llm import catalog, impacts, whitening
from workloom.llm.frames import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"
NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (901, [1.0, None, 0.0]), (902, [NAN, 0.0, 0.0]), (903, [INF, 0.0, 0.0]), (None, [0.5, 0.5, 0.25])]


def usable(rows, d=None):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and (d is None or len(v) == d)]


def whitened_by_force(rows, d):
    rows = usable(rows, d)
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - fit[0]
    cov = np.cov(y.T, bias=True).reshape(d, d)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    return [i for i, _ in rows], x, n, s, values, axes, x - fit[0] - y.mean(0)


def check_whitening(spark, table_rows, d, rank=None, **options):
    df = spark.createDataFrame(table_rows, SCHEMA).repartition(3).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    got = whitening.whiten(df, **options).collect()
    ids, x, n, s, values, axes, off = whitened_by_force(table_rows, d)
    k = min(16, rank or d)
    assert len(got) == k * len(ids)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    signs = {}
    for i, own, centred in zip(ids, x, off):
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, s))
        assert {r.deviation for r in by_id[i]} == {deviation}
        for r in by_id[i]:
            c = r.component - 1
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            want = float(centred @ axes[:, c]) / np.sqrt(values[c])
            if abs(want) > 1e-6:
                signs.setdefault(c, np.sign(want * r.whitened))
            assert r.whitened * signs.get(c, 1) == pytest.approx(want, abs=1e-7)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    mixed = rng.standard_normal((300, 20)) @ np.diag(np.linspace(0.1, 4, 20))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(mixed.astype(np.float32))]
    check_whitening(spark, rows + [(500 + i, rows[7][1]) for i in range(40)], 20, rows=16, fan=2)


def test_whitening_skips_odd_rows_and_empty_directions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(a), float(a), float(b)]) for i, (a, b) in enumerate(rng.standard_normal((50, 2)).astype(np.float32))]
    check_whitening(spark, rows + ODD[:4] + [(904, [1.0, 2.0]), (905, [])], 3, rank=2)
    assert whitening.whiten(spark.createDataFrame(rows[:1] * 3 + ODD[:4], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rank_one_updates_keep_orthogonal_vectors():
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (200, 12)).astype(float)
    x[:, 4], x[:, 5] = x[:, 3], 2.0
    one, two = whitening.Spectrum.empty(12), whitening.Spectrum.empty(12)
    for y in x[:90]:
        one.add(y)
    for y in x[90:]:
        two.add(y)
    one.combine(two)
    off = x - x.mean(0)
    want = off.T @ off
    assert np.abs(one.vectors.T @ one.vectors - np.eye(12)).max() < 1e-12
    assert np.abs(one.vectors @ np.diag(one.values) @ one.vectors.T - want).max() < 1e-10 * np.abs(want).max()


def test_deviation_of_any_size():
    x = np.array([[3, -4], [0, 1]], np.int64)
    assert whitening.deviations(x, 10 ** 6, [7, -9]) == [(3 * 10 ** 6 - 7) ** 2 + (-4 * 10 ** 6 + 9) ** 2, 49 + (10 ** 6 + 9) ** 2]
    assert whitening.deviations(x, 10 ** 12, [7, -9]) == [(3 * 10 ** 12 - 7) ** 2 + (-4 * 10 ** 12 + 9) ** 2, 49 + (10 ** 12 + 9) ** 2]


def top_by_force(rows, queries, k=5):
    rows = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in usable(rows) if i is not None]
    out = []
    for q, v in {(i, tuple(v)) for i, v in rows if i in queries}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def top(spark, rows, queries, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(2).withColumn("x", F.lit(1)).withColumn("slot", F.lit("s"))
    return sorted(map(tuple, impacts.top_inner_products(df, df.where(F.col("vec_id").isin(queries)), **options).collect()))


@pytest.mark.parametrize("block", [7, 100, 8192])
def test_top_inner_products_equal_brute_force(spark, block):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((300, 16)).astype(np.float32)
    v[100:140] = v[3]  # a vector that very many rows share
    rows = [(i, [float(x) for x in w]) for i, w in enumerate(v)] + ODD + [(7, [float(x) for x in v[8]]), (3, [float(x) for x in v[3]])]
    queries = list(range(0, 300, 20)) + [3, 7, 120]
    assert top(spark, rows, queries, block=block) == top_by_force(rows, queries)


def test_top_inner_products_of_odd_vectors(spark):
    rows = ODD + [(1, [1.0, -2.0, 0.5]), (2, [0.0, 0.0, 0.0]), (3, []), (4, [1.0]), (5, [3e4, 1.0, 0.0, 2.0]), (1, [1.0, -2.0, 0.5])]
    assert top(spark, rows, [1, 2, 3, 4, 5]) == top_by_force(rows, [1, 2, 3, 4, 5])
    assert top(spark, [], [1]) == []
    assert top(spark, ODD, [900]) == []


def test_proof_stops_before_the_end():
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((8_192, 64))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    block = impacts.Block(np.arange(8_192), vectors)
    query = block.vectors[17]
    ids, scores = block.best(17, query, 5)
    exact = block.vectors @ query
    exact[17] = -2 ** 62
    assert scores.tolist() == sorted(exact.tolist(), reverse=True)[:5] and exact[ids].tolist() == scores.tolist()
    assert len(block._possible(query, block.ids != 17, 5)) <= 8_192 // impacts.FEW


def test_queries_cover_whole_tables(spark):
    vectors = table(spark, SF, "embeddings")
    assert catalog.op12_whitening(spark, SF).count() == 16 * vectors.count()
    assert catalog.op13_impact_topk(spark, SF).count() == 5 * vectors.where("vec_id % 50 = 0").count()
