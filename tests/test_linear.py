import numpy as np
import pytest
from helpers import NAN, same
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import operators as op
from tidemark import plans
from tidemark.operators.linalg import covariance, covariance_of_vectors


def coordinates(spark, array):
    array = np.asarray(array, float)
    names = [f"d{k}" for k in range(array.ndim)]
    rows = [(*map(int, at), float(x)) for at, x in np.ndenumerate(array)]
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", x double"), names


def dense(df, shape):
    out = np.zeros(shape)
    for row in df.collect():
        out[tuple(row)[:-1]] = row[-1]
    return out


@pytest.mark.parametrize(
    "equation, shapes",
    [
        ("ij,jk->ik", [(2, 3), (3, 4)]),
        ("bij,bjk->bik", [(2, 2, 3), (2, 3, 2)]),
        ("i,i->", [(4,), (4,)]),
        ("ii->", [(3, 3)]),
        ("ij->ji", [(2, 3)]),
        ("ij->j", [(2, 3)]),
        ("i,j->ij", [(2,), (3,)]),
        ("i,ij,j->", [(2,), (2, 3), (3,)]),
        ("...ij,...jk->...ik", [(2, 2, 3), (2, 3, 2)]),
        ("ij,jk", [(2, 3), (3, 4)]),
        ("ij,jk,kl->il", [(2, 3), (3, 4), (4, 2)]),
    ],
)
def test_einsum(spark, equation, shapes):
    rng = np.random.default_rng(1)
    arrays = [rng.normal(size=s) for s in shapes]
    want = np.einsum(equation, *arrays)
    got = op.einsum(equation, *(coordinates(spark, a) for a in arrays))
    assert np.allclose(dense(got, want.shape), want)


def test_project(spark):
    rng = np.random.default_rng(2)
    a, x = rng.normal(size=(2, 3)), rng.normal(size=(4, 3))
    assert np.allclose(dense(op.project(coordinates(spark, a), coordinates(spark, x)), (4, 2)), x @ a.T)
    with pytest.raises(ValueError):
        op.einsum("ij,jk->ik", coordinates(spark, a))


def matrix(spark, *arrays):
    rows = [(b, int(r), int(c), float(x)) for b, a in enumerate(arrays) for (r, c), x in np.ndenumerate(np.asarray(a, float))]
    return spark.createDataFrame(rows, "b int, r int, c int, x double")


def test_eigh(spark):
    arrays = [np.array([[4, -2], [-2, 3]]), np.array([[3, 1, 1], [1, 3, 1], [1, 1, 3]])]
    rows = op.eigh(matrix(spark, *arrays), ["b"]).orderBy("b", "k").collect()
    for b, a in enumerate(arrays):
        own = [r for r in rows if r.b == b]
        values = [r.eigenvalue for r in own]
        assert values == sorted(values)
        for r in own:
            assert np.allclose(a @ r.eigenvector, r.eigenvalue * np.array(r.eigenvector))
    assert np.allclose([r.eigenvalue for r in rows if r.b == 0], [1.4384, 5.5616], atol=1e-4)


def test_orthonormalize(spark):
    a = np.random.default_rng(3).normal(size=(3, 5))
    v = np.array([r.vector for r in op.orthonormalize(matrix(spark, a), ["b"]).orderBy("r").collect()])
    assert np.allclose(v @ v.T, np.eye(3)) and np.allclose(v[0], a[0] / np.linalg.norm(a[0]))


def test_orthogonalize(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 0.0), (1, 1.0, 0.0)], "k int, x double, y double")
    got = [r.orthogonal for r in op.orthogonalize(df, "x", "y", ["k"]).orderBy("k", "x").collect()]
    assert got == [0.0, 2.0, None]


def test_pca(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(0, int(s), int(d), float(v)) for (s, d), v in np.ndenumerate(x)], "b int, s int, d int, x double")
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for made in (op.pca(df, ["b"], "s", "d", "x"), op.nanpca(df, ["b"], "s", "d", "x")):
        rows = made.orderBy("k").collect()
        assert np.allclose([r.explained_variance for r in rows], values[::-1])
        for r, v in zip(rows, vectors.T[::-1], strict=True):
            assert abs(abs(np.dot(r.component, v)) - 1) < 1e-9
    holes = df.withColumn("x", F.when((F.col("s") + F.col("d")) % 9 == 0, F.lit(NAN)).otherwise(F.col("x")))
    assert op.nanpca(holes, ["b"], "s", "d", "x").count() == 4


def test_random_columns_do_not_depend_on_partitions(spark):
    one = {r.id: r.value for r in op.rand_table(spark, 500).collect()}
    df = spark.range(500).repartition(7)
    other = {r.id: r.rand for r in op.with_rand(df, "id").collect()}
    assert one == other and 0 <= min(one.values()) and max(one.values()) < 1
    assert {r.id: r.value for r in op.rand_table(spark, 500, seed=1).collect()} != one


def test_random_moments(spark):
    row = op.randn_table(spark, 20_000).agg(F.avg("value"), F.stddev("value")).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03
    row = op.randint_table(spark, -2, 3, 5_000).agg(F.min("value"), F.max("value"), F.avg("value")).first()
    assert (row[0], row[1]) == (-2, 2) and abs(row[2]) < 0.1
    with pytest.raises(ValueError):
        fn.randint(1, 1, "id")
    # Neighbours tell nothing of each other, nor do other streams and seeds.
    df = spark.range(20_000).select(fn.rand("id").alias("a"), fn.rand(F.col("id") + 1).alias("b"), fn.rand("id", stream=1).alias("c"), fn.rand("id", seed=43).alias("d"), fn.rand(F.lit(5), "id").alias("e"))
    x = np.array(df.toPandas())
    assert np.abs(np.corrcoef(x.T) - np.eye(5)).max() < 0.03 and np.abs(x.mean(0) - 0.5).max() < 0.01 and np.abs(x.var(0) - 1 / 12).max() < 0.003
    counts = np.histogram2d(x[:, 0], x[:, 1], bins=10)[0]
    assert ((counts - 200) ** 2 / 200).sum() < 200  # chi square of 99 degrees
    assert spark.range(-50, 50).select(fn.hash62(F.col("id") * (1 << 40)).alias("h")).distinct().count() == 100


def test_randperm(spark):
    for n in (0, 1, 2, 3, 10, 300, 1000):
        values = [r.value for r in op.randperm(spark, n).orderBy("id").collect()]
        assert sorted(values) == list(range(n)) and (n < 10 or values != list(range(n)))
    other = op.with_permuted(spark.range(1000).repartition(7), "id", 1000).orderBy("id").collect()
    assert [r.value for r in other] == values != [r.value for r in op.randperm(spark, 1000, seed=7).orderBy("id").collect()]
    plan = op.randperm(spark, 10**6)
    assert plan.agg(F.count_distinct("value"), F.min("value"), F.max("value")).first()[:] == (10**6, 0, 10**6 - 1)
    assert not {"Exchange", "Sort", "Join"} & set(plan._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())
    odd = spark.createDataFrame([(None,), (-1,), (5,)], "id bigint")
    assert [r.value for r in op.with_permuted(odd, "id", 5).collect()] == [None] * 3


def embeddings(spark, tmp_path, n, labels=3):
    """A table of n vectors of 64 coordinates, as the queries read it."""
    x = np.random.default_rng(6).normal(1, 1, (n, 64)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), k % labels) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return x.astype(float)


def test_orthonormalize_query_has_all_vectors_whole(spark, tmp_path):
    x = embeddings(spark, tmp_path, 50)
    rows: dict = {}
    for r in plans.queries()["orthonormalize"](spark, str(tmp_path)).orderBy("vec_id", "idx").collect():
        rows.setdefault(r.vec_id, []).append(r.x)
    assert sorted(rows) == list(range(50))
    for first in range(0, 50, 4):
        made = []
        for v in x[first : first + 4]:
            for u in made:
                v = v - v @ u * u
            made.append(v / np.linalg.norm(v))
        assert np.allclose([rows[first + k] for k in range(len(made))], made, atol=1e-5)


def test_decompositions_have_all_coordinates(spark, tmp_path):
    x = embeddings(spark, tmp_path, 300)
    holes = np.where((np.arange(300)[:, None] + np.arange(64)) % 10 == 0, NAN, x)

    def pairwise(a):
        have, a = ~np.isnan(a), np.nan_to_num(a)
        n, sums = have.T.astype(float) @ have, a.T @ have
        return (a.T @ a - sums * sums.T / n) / (n - 1)

    for name, value, vector, of in (
        ("eigh", "eigenvalue", "eigenvector", lambda s: x[s].T @ x[s]),
        ("pca_cov", "explained_variance", "component", lambda s: x[s].T @ x[s]),
        ("pca", "explained_variance", "component", lambda s: np.cov(x[s].T)),
        ("nanpca", "explained_variance", "component", lambda s: pairwise(holes[s])),
    ):
        rows = plans.queries()[f"{name}_rows"](spark, str(tmp_path)).collect()
        for label in range(3):
            want = of(np.arange(300) % 3 == label)
            own = sorted((r for r in rows if r.label == label), key=lambda r: r.k)
            values, vectors = np.array([r[value] for r in own]), np.array([r[vector] for r in own])
            assert vectors.shape == (64, 64)
            expected = np.linalg.eigvalsh(want)
            assert np.allclose(values, expected if name == "eigh" else expected[::-1], atol=1e-4)
            assert np.allclose(vectors @ vectors.T, np.eye(64), atol=2e-3)
            assert np.abs(vectors @ want - values[:, None] * vectors).max() < 1e-3 * np.abs(values).max()


def test_covariance_of_vectors(spark):
    rows = [(0, [1e9 + 1, 2.0, None]), (0, [1e9 + 2, NAN, 1.0]), (0, [1e9 + 4, 5.0, 3.0]), (0, [1e9 + 7, 6.0]), (1, [1.0, 2.0]), (None, [1.0, 1.0]), (0, None)]
    df = spark.createDataFrame([(s, *row) for s, row in enumerate(rows)], "s int, b int, v array<double>").repartition(3)
    cells = df.select("s", "b", F.posexplode("v").alias("d", "x"))
    for skip in (False, True):
        got = {(r.b, r.r, r.c): r.x for r in covariance_of_vectors(df, ["b"], "v", skip_missing=skip).collect()}
        want = {(r.b, r.r, r.c): r.x for r in covariance(cells, ["b"], "s", "d", "x", skip_missing=skip).collect()}
        assert set(got) == set(want) and same([got[k] for k in want], list(want.values()), 1e-6)


def test_missing_values_give_null(spark):
    hole = [(0, 0, 1.0), (0, 1, NAN), (1, 0, None), (1, 1, 2.0)]
    df = spark.createDataFrame(hole, "r int, c int, x double")
    other = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.0)], "r int, c int, x double")
    rows = {(r.i0, r.i1): r.x for r in op.einsum("ij,jk->ik", (df, ["r", "c"]), (other, ["r", "c"])).collect()}
    assert rows == {(0, 0): None, (1, 0): None}
    ones = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 2.0)], "r int, c int, x double")
    rows = {(r.i0, r.i1): r.x for r in op.project((ones, ["r", "c"]), (df, ["r", "c"])).collect()}
    assert rows == {(0, 0): None, (0, 1): None, (1, 0): None, (1, 1): None}
    assert op.einsum("ii->", (df, ["r", "c"])).first().x == 3.0


def test_decompositions_of_matrices_with_holes(spark):
    good = [(0, r, c, float(4 * (r == c) + 1)) for r in range(3) for c in range(3)]
    hole = [(1, r, c, NAN if (r, c) == (2, 0) else 1.0) for r in range(3) for c in range(3)]
    upper = [(2, r, c, None if (r, c) == (0, 1) else float(r == c)) for r in range(2) for c in range(2)]
    df = spark.createDataFrame(good + hole + upper, "b int, r int, c int, x double")
    rows = op.eigh(df, ["b"]).orderBy("b", "k").collect()
    assert same([r.eigenvalue for r in rows], [4, 4, 7, None, None, None, 1, 1]) and [r.eigenvector is None for r in rows] == [False] * 3 + [True] * 3 + [False] * 2
    assert same([r.explained_variance for r in op.pca_cov(df, ["b"]).orderBy("b", "k").collect()], [7, 4, 4] + [None] * 5)
    assert [r.vector is None for r in op.orthonormalize(df.where("b < 2"), ["b"]).orderBy("b", "r").collect()] == [False] * 3 + [True] * 3
    # A matrix of which only one triangle has rows.
    half = spark.createDataFrame([(0, 1, 0, 2.0)], "b int, r int, c int, x double")
    assert same([r.eigenvalue for r in op.eigh(half, ["b"]).orderBy("k").collect()], [-2, 2])


def test_pca_with_a_missing_value(spark):
    rng = np.random.default_rng(9)
    rows = [(b, s, d, None if (b, s, d) == (1, 3, 1) else float(x)) for b in range(2) for (s, d), x in np.ndenumerate(rng.normal(size=(20, 3)))]
    df = spark.createDataFrame(rows, "b int, s int, d int, x double")
    found = {r.b: r.explained_variance is None for r in op.pca(df, ["b"], "s", "d", "x").collect()}
    assert found == {0: False, 1: True}
    assert all(r.explained_variance is not None for r in op.nanpca(df, ["b"], "s", "d", "x").collect())
    alone = df.where("b = 0").withColumn("x", F.when((F.col("d") == 0) & (F.col("s") > 0), F.lit(NAN)).otherwise(F.col("x")))
    assert all(r.explained_variance is None for r in op.nanpca(alone, ["b"], "s", "d", "x").collect())


@pytest.mark.parametrize("equation, shapes", [("bsi,bsj->bij", [(2, 9, 4), (2, 9, 5)]), ("sik,jik->sj", [(11, 3, 2), (4, 3, 2)]), ("ij,jk,kl->il", [(7, 6), (6, 5), (5, 8)])])
def test_products_of_several_tiles(spark, monkeypatch, equation, shapes):
    from tidemark.operators import linalg

    monkeypatch.setattr(linalg, "TILE", 2)
    rng = np.random.default_rng(1)
    arrays = [rng.normal(size=s) for s in shapes]
    want = np.einsum(equation, *arrays)
    assert np.allclose(dense(op.einsum(equation, *(coordinates(spark, a) for a in arrays)), want.shape), want)


def test_products_of_sparse_tables_with_holes(spark):
    a = spark.createDataFrame([("p", 0, NAN), ("p", 1, 2.0), ("q", 1, 3.0), ("q", None, 9.0), (None, 1, 5.0)], "r string, k int, x double")
    b = spark.createDataFrame([(1, "u", 10.0), (0, "w", 1.0), (1, "v", None), (None, "u", 7.0)], "k bigint, c string, x double")
    rows = {(r.i0, r.i1): r.x for r in op.einsum("rk,kc->rc", (a, ["r", "k"]), (b, ["k", "c"])).collect()}
    assert rows == {("p", "u"): 20.0, ("p", "w"): None, ("p", "v"): None, ("q", "u"): 30.0, ("q", "v"): None, (None, "u"): 50.0, (None, "v"): None}
    assert op.einsum("rk,kc->rc", (a.limit(0), ["r", "k"]), (b, ["k", "c"])).collect() == []


def test_leading_components_of_wide_vectors(spark):
    rng = np.random.default_rng(5)
    n, d = 60, 5000
    factors = rng.normal(size=(n, 6)) * np.array([30.0, 20, 12, 8, 5, 3])
    x = factors @ np.linalg.qr(rng.normal(size=(d, 6)))[0].T + 0.01 * rng.normal(size=(n, d)) + rng.normal(size=d)
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(3)
    rows = op.pca_top(df, "v", 4).collect()
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose([r.explained_variance for r in rows], s[:4] ** 2 / (n - 1), rtol=1e-9)
    for r, v in zip(rows, vt, strict=False):
        assert abs(abs(np.dot(r.component, v)) - 1) < 1e-9 and np.abs(np.array(r.component) - v * np.sign(np.dot(r.component, v))).max() < 1e-6
        assert r.component[int(np.argmax(np.round(np.abs(r.component), 9)))] > 0


def test_leading_components_of_odd_tables(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],), ([3.0, 3.0],)], "v array<float>")
    assert same([r.explained_variance for r in op.pca_top(df, "v", 5).collect()], [1.5, 0.5], 1e-9)
    assert op.pca_top(df.limit(0), "v", 2).collect() == []
    for bad in ([[1.0, NAN]], [None], [[1.0, None]]):
        hole = df.union(spark.createDataFrame([(b,) for b in bad], "v array<float>"))
        assert [tuple(r) for r in op.pca_top(hole, "v", 1).collect()] == [(0, None, None)]
    with pytest.raises(ValueError):
        op.pca_top(df.union(spark.createDataFrame([([1.0],)], "v array<float>")), "v", 1)
