"""Linear algebra over the embeddings, and random tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..functions.scalars import PERMUTING, PRIME, ROUNDS, start_of
from ..operators.linalg import covariance, covariance_of_vectors, gram_of_vectors
from ..sources import read_table
from .common import Query, rounded, sql_rounded


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, idx, x``: the embeddings' coordinates as rows."""
    df = read_table(spark, sf_dir, "embeddings", ["vec_id", "label", "embedding"])
    return df.select("vec_id", "label", F.posexplode("embedding").alias("idx", "x")).withColumn("x", F.col("x").cast("double"))


CELLS = "c AS (SELECT vec_id, label, unnest(range(len(embedding))) AS idx, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label, idx, x``: the mean embedding of each label."""
    return cells(spark, sf_dir).groupBy("label", "idx").agg(F.avg("x").alias("x"))


def einsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against each label's mean: si,oi->so."""
    x, w = cells(spark, sf_dir), _weights(spark, sf_dir)
    made = op.einsum("si,oi->so", (x.select("vec_id", "idx", "x"), ["vec_id", "idx"]), (w, ["label", "idx"]))
    return made.select(F.col("i0").alias("vec_id"), F.col("i1").alias("label"), rounded("x").alias("x"))


def einsum_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gram matrices of each label's coordinates: bsi,bsj->bij."""
    x = cells(spark, sf_dir)
    made = op.einsum("bsi,bsj->bij", (x, ["label", "vec_id", "idx"]), (x, ["label", "vec_id", "idx"]))
    return made.select(F.col("i0").alias("label"), F.col("i1").alias("a"), F.col("i2").alias("b"), rounded("x").alias("x"))


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = cells(spark, sf_dir).select("vec_id", "idx", "x"), _weights(spark, sf_dir)
    made = op.project((w, ["label", "idx"]), (x, ["vec_id", "idx"]))
    return made.select(F.col("i0").alias("vec_id"), F.col("i1").alias("label"), rounded("x").alias("x"))


def orthogonalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector less its projection on its label's mean."""
    x = cells(spark, sf_dir).join(_weights(spark, sf_dir).withColumnRenamed("x", "y"), ["label", "idx"])
    return op.orthogonalize(x, "x", "y", ["vec_id"], out="result").select("vec_id", "idx", rounded("result").alias("result"))


def _gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read_table(spark, sf_dir, "embeddings", ["label", "embedding"])
    return gram_of_vectors(x, ["label"], "embedding").withColumn("x", rounded("x"))


def eigh_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues and eigenvectors of each label's Gram matrix."""
    made = op.eigh(_gram(spark, sf_dir), ["label"])
    return made.select("label", "k", rounded("eigenvalue", 4).alias("eigenvalue"), F.transform("eigenvector", lambda v: rounded(v, 4)).alias("eigenvector"))


def _rebuilt(parts: DataFrame, value: str, vector: str, sign: int) -> DataFrame:
    """``label, r, c, x, same, ordered``: each matrix put together again from its values and vectors.

    x is the sum of value times vector times vector, same the sum without the
    values (1 on the diagonal, else 0, as vectors are orthonormal), and ordered
    how many values follow the one before in the order asked for, or equal it.
    """
    order = Window.partitionBy("label").orderBy("k")
    follows = F.coalesce((F.col(value) - F.lag(value).over(order)) * sign >= 0, F.lit(True)).cast("int")
    rows = parts.select("label", "k", value, vector, follows.alias("follows"))
    rows = rows.select("*", F.posexplode(vector).alias("r", "a")).select("label", "follows", value, "r", "a", F.posexplode(vector).alias("c", "b"))
    share = F.col("a") * F.col("b")
    made = rows.groupBy("label", "r", "c").agg(rounded(F.sum(F.col(value) * share)).alias("x"), rounded(F.sum(share), 4).alias("same"), F.sum("follows").alias("ordered"))
    return made


def eigh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's Gram matrix, rebuilt from what eigh gives."""
    return _rebuilt(op.eigh(_gram(spark, sf_dir), ["label"]), "eigenvalue", "eigenvector", 1)


def orthonormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, in blocks of four, whole."""
    rows = cells(spark, sf_dir).withColumn("b", F.floor(F.col("vec_id") / 4))
    made = op.orthonormalize(rows, ["b"], ("vec_id", "idx", "x"))
    return made.select("b", F.col("r").alias("vec_id"), F.posexplode("vector").alias("idx", "x")).withColumn("x", rounded("x", 5))


def _vectors(spark: SparkSession, sf_dir: str, holes: bool) -> DataFrame:
    """``label, embedding``, with NaN in every tenth cell where holes are asked for."""
    x = read_table(spark, sf_dir, "embeddings", ["vec_id", "label", "embedding"])
    cut = F.transform("embedding", lambda v, k: F.when((F.col("vec_id") + k) % 10 == 0, F.lit(float("nan"))).otherwise(v.cast("double")))
    return x.select("label", (cut if holes else F.col("embedding")).alias("embedding"))


def _covariance(skip: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = covariance_of_vectors(_vectors(spark, sf_dir, skip), ["label"], "embedding", skip_missing=skip)
        return made.select("label", "r", "c", rounded("x").alias("x"))

    return query


def covariance_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from rows of coordinates, a tenth of which are missing."""
    x = cells(spark, sf_dir)
    x = x.withColumn("x", F.when((F.col("vec_id") + F.col("idx")) % 10 == 0, F.lit(float("nan"))).otherwise(F.col("x")))
    return covariance(x, ["label"], "vec_id", "idx", "x", skip_missing=True).select("label", "r", "c", rounded("x").alias("x"))


def _covariance_sql(skip: bool) -> str:
    x = "CASE WHEN (vec_id + idx) % 10 = 0 THEN NULL ELSE x END" if skip else "x"
    return f"WITH {CELLS}, h AS (SELECT vec_id, label, idx, {x} AS x FROM c) SELECT a.label, a.idx::INT AS r, b.idx::INT AS c, {sql_rounded('covar_samp(a.x, b.x)')} AS x FROM h a JOIN h b USING (label, vec_id) GROUP BY a.label, a.idx, b.idx"


def _rebuilt_sql(matrix: str) -> str:
    """The matrix itself, from SQL for ``label, r, c, x``."""
    return f"SELECT label, r, c, x, (r = c)::INT::DOUBLE AS same, count(*) OVER (PARTITION BY label, r) AS ordered FROM ({matrix})"


def _components(df: DataFrame) -> DataFrame:
    return df.select("label", "k", rounded("explained_variance", 4).alias("explained_variance"), F.transform("component", lambda v: rounded(v, 4)).alias("component"))


def _pca(holes: bool) -> Query:
    def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = covariance_of_vectors(_vectors(spark, sf_dir, holes), ["label"], "embedding", skip_missing=holes)
        return op.pca_cov(x, ["label"])

    return parts


def _pca_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.pca_cov(_gram(spark, sf_dir), ["label"])


def pca_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the first five components of all embeddings: how often the covariance, cell by cell, says what pca_top does.

    A component times the covariance is its variance times itself; of each
    component the largest deviation is given, in units of the first variance, and
    the variances' order.
    """
    x = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    made = op.pca_top(x, "embedding", 5)
    cov = covariance_of_vectors(x.withColumn("one", F.lit(1)), ["one"], "embedding", skip_missing=False)
    parts = made.select("k", "explained_variance", F.posexplode("component").alias("c", "v"))
    times = cov.join(F.broadcast(parts), "c").groupBy("k", "r").agg(F.sum(F.col("x") * F.col("v")).alias("times"))
    both = times.join(F.broadcast(parts.withColumnRenamed("c", "r")), ["k", "r"])
    first = F.max("explained_variance").over(Window.partitionBy())
    off = both.groupBy("k").agg(F.max(F.abs(F.col("times") - F.col("explained_variance") * F.col("v"))).alias("off"), F.sum(F.col("v") * F.col("v")).alias("norm"), F.first("explained_variance").alias("explained_variance"))
    trace = cov.where("r = c").agg(F.sum("x").alias("trace"))
    most = off.withColumn("most", first).join(F.broadcast(trace))
    return most.select("k", F.round(F.col("off") / F.col("most"), 6).alias("off"), rounded("norm").alias("norm"), (F.col("explained_variance") * 64 >= F.col("trace") / 2).cast("int").alias("large"))


def _component_rows(parts: Query) -> Query:
    """Variances and components themselves."""
    return lambda spark, sf_dir: _components(parts(spark, sf_dir))


def _component_matrix(parts: Query) -> Query:
    """The matrix rebuilt from variances and components."""
    return lambda spark, sf_dir: _rebuilt(parts(spark, sf_dir), "explained_variance", "component", -1)


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' ids."""
    return read_table(spark, sf_dir, "events", ["event_id"]).select(F.col("event_id").alias("id"))


def rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_rand(_ids(spark, sf_dir), "id", out="value")


def randn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_randn(_ids(spark, sf_dir), "id", out="value").select("id", rounded("value", 9).alias("value"))


def randint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).withColumn("value", fn.randint(-5, 6, "id"))


def rand_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_rand(read_table(spark, sf_dir, "customer", ["c_custkey"]), "c_custkey")


def randn_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_randn(read_table(spark, sf_dir, "customer", ["c_custkey"]), "c_custkey").select("c_custkey", rounded("randn", 9).alias("randn"))


def randperm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' ids, which are 0 to one less than their number, in a random order."""
    ids = _ids(spark, sf_dir)
    return op.with_permuted(ids, "id", ids.count())


def permuted_sql(seed: int = 42) -> str:
    """The permuting network, passed until the place is one of the ids."""

    def pass_over(y: str) -> str:
        columns = [f"{y} // b AS h0", f"{y} % b AS l0"]
        names = ["h0", "l0"]
        for k in range(PERMUTING):
            made = f"({names[(k + 1) % 2]} + {start_of(seed, 1000 + k)})"
            for flipped, times, prime in ROUNDS:
                made = f"((xor(({made})::BIGINT, {flipped}) * {times} + 1) % {prime})"
            name = f"{'hl'[k % 2]}{k + 1}"
            columns.append(f"({names[k % 2]} + {made}) % {'ab'[k % 2]} AS {name}")
            names[k % 2] = name
        return f"{', '.join(columns)}, ({names[0]} * b + {names[1]})::BIGINT AS y"

    return f"""WITH RECURSIVE grid AS (SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b FROM events),
    w AS (
      SELECT id, y FROM (SELECT event_id AS id, {pass_over('event_id')} FROM events, grid)
      UNION ALL
      SELECT id, y FROM (SELECT id, {pass_over('w0')} FROM (SELECT id, y AS w0, n, a, b FROM w, grid WHERE y >= n))
    ) SELECT id, y AS value FROM w, grid WHERE y < n"""


def hash_sql(x: str, stream: int, seed: int = 42) -> str:
    """The 31-bit hash of functions.scalars in SQL."""
    made = str(start_of(seed, stream))
    for part in (f"(({x}) % {PRIME} + {PRIME}) % {PRIME}", f"(({x}) >> 31) % {PRIME}"):
        made = f"{made} + {part}"
        for flipped, times, prime in ROUNDS:
            made = f"((xor(({made})::BIGINT, {flipped}) * {times} + 1) % {prime})"
    return f"({made})"


def rand_sql(x: str, stream: int = 0) -> str:
    return f"(({hash_sql(x, 2 * stream)}::DOUBLE + floor({hash_sql(x, 2 * stream + 1)} / 512.0)::DOUBLE / 4194304.0::DOUBLE) / {PRIME}.0::DOUBLE)"


def hash62_sql(x: str, stream: int) -> str:
    return f"({hash_sql(x, 2 * stream)} * 2147483648 + {hash_sql(x, 2 * stream + 1)})"


def randn_sql(x: str) -> str:
    return sql_rounded(f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {rand_sql(x, 1)})) * cos({2 * math.pi!r}::DOUBLE * {rand_sql(x, 2)})", 9)


_IDS = "ids AS (SELECT event_id AS id FROM events)"

#: Gram and Schmidt, a vector of each block of four at a time: its share of each one before is taken off.
_ORTHONORMAL = """WITH RECURSIVE v AS (
  SELECT vec_id, vec_id // 4 AS b, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id) AS k, embedding::DOUBLE[] AS e FROM embeddings
), step AS (
  SELECT b, 0::BIGINT AS k, NULL::BIGINT AS vec_id, NULL::DOUBLE[] AS u, []::DOUBLE[][] AS made FROM (SELECT DISTINCT b FROM v)
  UNION ALL
  SELECT b, k, vec_id, u, list_append(made, u) FROM (
    SELECT b, k, vec_id, made, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS u FROM (
      SELECT v.b, v.k, v.vec_id, step.made,
        list_transform(range(len(e)), lambda i: e[i + 1] - coalesce(list_sum(list_transform(step.made, lambda m: list_dot_product(m, e) * m[i + 1])), 0)) AS w
      FROM step JOIN v ON v.b = step.b AND v.k = step.k + 1))
)
SELECT b, vec_id, idx, round(x, 5) + 0.0 AS x FROM (SELECT b, vec_id, unnest(range(len(u)))::INT AS idx, unnest(u) AS x FROM step WHERE k > 0)"""


_MEAN = f"WITH {CELLS}, w AS (SELECT label, idx, avg(x) AS x FROM c GROUP BY label, idx)"

_GRAM = f"WITH {CELLS} SELECT a.label, a.idx::INT AS r, b.idx::INT AS c, {sql_rounded('sum(a.x * b.x)')} AS x FROM c a JOIN c b USING (label, vec_id) GROUP BY a.label, a.idx, b.idx"

PLANS: dict[str, tuple[Query, str | None]] = {
    "einsum": (einsum, f"{_MEAN} SELECT vec_id, w.label, {sql_rounded('sum(c.x * w.x)')} AS x FROM c JOIN w USING (idx) GROUP BY vec_id, w.label"),
    "einsum_gram": (einsum_gram, f"WITH {CELLS} SELECT a.label, a.idx::INT AS a, b.idx::INT AS b, {sql_rounded('sum(a.x * b.x)')} AS x FROM c a JOIN c b USING (label, vec_id) GROUP BY a.label, a.idx, b.idx"),
    "project": (project, f"{_MEAN} SELECT vec_id, w.label, {sql_rounded('sum(c.x * w.x)')} AS x FROM c JOIN w USING (idx) GROUP BY vec_id, w.label"),
    "orthogonalize": (
        orthogonalize,
        f"{_MEAN}, j AS (SELECT c.vec_id, c.idx, c.x, w.x AS y FROM c JOIN w USING (label, idx)) SELECT vec_id, idx::INT AS idx, {sql_rounded('x - sum(x * y) OVER g / nullif(sum(y * y) OVER g, 0) * y')} AS result FROM j WINDOW g AS (PARTITION BY vec_id)",
    ),
    "covariance": (_covariance(False), _covariance_sql(False)),
    "nancovariance": (_covariance(True), _covariance_sql(True)),
    "covariance_of_cells": (covariance_of_cells, _covariance_sql(True)),
    "eigh": (eigh, _rebuilt_sql(_GRAM)),
    "eigh_rows": (eigh_rows, None),
    "orthonormalize": (orthonormalize, _ORTHONORMAL),
    "pca_cov": (_component_matrix(_pca_cov), _rebuilt_sql(_GRAM)),
    "pca_cov_rows": (_component_rows(_pca_cov), None),
    "pca": (_component_matrix(_pca(False)), _rebuilt_sql(_covariance_sql(False))),
    "pca_rows": (_component_rows(_pca(False)), None),
    "nanpca": (_component_matrix(_pca(True)), _rebuilt_sql(_covariance_sql(True))),
    "nanpca_rows": (_component_rows(_pca(True)), None),
    "pca_top": (pca_top, "SELECT k, 0.0::DOUBLE AS off, 1.0::DOUBLE AS norm, 1 AS large FROM (SELECT unnest(range(5)) AS k) WHERE (SELECT count(*) FROM embeddings) > 1"),
    "rand": (rand, f"WITH {_IDS} SELECT id, {rand_sql('id')} AS value FROM ids"),
    "rand_like": (rand_like, f"SELECT c_custkey, {rand_sql('c_custkey')} AS rand FROM customer"),
    "randn": (randn, f"WITH {_IDS} SELECT id, {randn_sql('id')} AS value FROM ids"),
    "randn_like": (randn_like, f"SELECT c_custkey, {randn_sql('c_custkey')} AS randn FROM customer"),
    "randint": (randint, f"WITH {_IDS} SELECT id, -5 + {hash62_sql('id', 3)} % 11 AS value FROM ids"),
    "randperm": (randperm, permuted_sql()),
}


