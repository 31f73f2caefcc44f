"""Linear algebra over coordinate rows, and over small dense matrices group by group."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import Series, divide, helper_names, present


def _subscripts(equation: str, ranks: list[int]) -> tuple[list[list[str]], list[str]]:
    """Index names of each operand and of the result; an ellipsis stands for the leading indices left over."""
    left, arrow, right = equation.replace(" ", "").partition("->")
    terms = left.split(",")
    if len(terms) != len(ranks):
        raise ValueError(f"{len(terms)} terms for {len(ranks)} operands")

    def names(term: str, extra: int) -> list[str]:
        head, dots, tail = term.partition("...")
        return list(head) + [f"_e{k}" for k in range(-extra, 0)] * bool(dots) + list(tail)

    extras = [rank - len(term.replace("...", "")) if "..." in term else 0 for term, rank in zip(terms, ranks, strict=True)]
    inputs = [names(term, extra) for term, extra in zip(terms, extras, strict=True)]
    for found, rank in zip(inputs, ranks, strict=True):
        if len(found) != rank:
            raise ValueError(f"{len(found)} subscripts for {rank} indices")
    if arrow:
        return inputs, names(right, max(extras))
    letters = re.findall(r"[A-Za-z]", left)
    return inputs, [f"_e{k}" for k in range(-max(extras), 0)] + sorted(c for c in set(letters) if letters.count(c) == 1)


#: Different index tuples of a tile's side.
TILE = 1024


def _codes(table: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for each different tuple of the columns, and a row that has each."""
    codes = np.zeros(table.num_rows, np.int64)
    for c in columns:
        own = table.column(c).combine_chunks().dictionary_encode()
        own = own.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        codes = np.unique(codes * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return codes, first


def _multiplied(left: np.ndarray, right: np.ndarray, in_left: np.ndarray, in_right: np.ndarray) -> np.ndarray:
    """left times right over their first index, where absent cells take no part, not even beside NaN or infinity."""
    if np.isfinite(left).all() and np.isfinite(right).all():
        return left.T @ right
    made = np.zeros((left.shape[1], right.shape[1]))
    with np.errstate(invalid="ignore"):
        for k in range(len(left)):
            a, b = np.flatnonzero(in_left[k]), np.flatnonzero(in_right[k])
            made[np.ix_(a, b)] += np.outer(left[k, a], right[k, b])
    return made


def _tiled(left: DataFrame, right: DataFrame, batch: list[str], summed: list[str], a: str, b: str) -> DataFrame:
    """``batch, other indices, _v``: the product of two coordinate tables, summed over indices that both have, tile by tile.

    Index tuples of each kind are dealt to tiles by a hash, in as many as their
    counts ask for, and a task multiplies two tiles as dense matrices: what is
    shuffled is a partial sum for each tile of the summed indices instead of a
    product for each of them.
    """
    both = [*batch, *summed]
    left, right = left.dropna(subset=both), right.dropna(subset=both)
    free_left, free_right = ([c for c in df.columns if c not in both and c != v] for df, v in ((left, a), (right, b)))
    t = helper_names(left.select(*both, *free_left).join(right.select(*(F.lit(1).alias(c) for c in free_right)).limit(0)))

    def tiles(columns: list[str]) -> Column:
        return (1 + F.floor(F.approx_count_distinct(F.struct(*columns)) / TILE)).cast("int")

    def dealt(columns: list[str], parts: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.col(parts)).cast("int")

    on_left = left.groupBy(*batch).agg(tiles(summed).alias(t("sums")), tiles(free_left).alias(t("lefts")))
    on_right = right.groupBy(*batch).agg(tiles(free_right).alias(t("rights")))
    sizes = on_left.join(on_right, batch) if batch else on_left.crossJoin(F.broadcast(on_right))  # one row each
    with_sizes = (lambda df: df.join(sizes, batch)) if batch else (lambda df: df.crossJoin(F.broadcast(sizes)))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    keys = [*batch, t("sum"), t("left"), t("right")]
    lefts = with_sizes(left).select(*left.columns, dealt(summed, t("sums")).alias(t("sum")), dealt(free_left, t("lefts")).alias(t("left")), every(t("rights")).alias(t("right")))
    rights = with_sizes(right).select(*right.columns, dealt(summed, t("sums")).alias(t("sum")), dealt(free_right, t("rights")).alias(t("right")), every(t("lefts")).alias(t("left")))
    names = [*batch, *free_left, *free_right, "_v"]

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        n = one.num_rows if other.num_rows else 0
        if not n:
            kinds = {c: (one if c in one.schema.names else other).schema.field(c).type for c in names[:-1]} | {"_v": pa.float64()}
            return pa.table({c: pa.array([], k) for c, k in kinds.items()})
        k, _ = _codes(pa.concat_tables([one.select(summed), other.select(summed)], promote_options="permissive"), summed)
        rows, first_row = _codes(one, free_left)
        columns, first_column = _codes(other, free_right)
        shape = int(k.max()) + 1
        grids = []
        for at, codes, table, v in ((k[:n], rows, one, a), (k[n:], columns, other, b)):
            grid, there = np.zeros((shape, codes.max() + 1)), np.zeros((shape, codes.max() + 1), bool)
            np.add.at(grid, (at, codes), table.column(v).to_numpy())
            there[at, codes] = True
            grids.append((grid, there))
        (left_grid, in_left), (right_grid, in_right) = grids
        made = _multiplied(left_grid, right_grid, in_left, in_right)
        r, c = np.nonzero(in_left.T.astype(np.float32) @ in_right.astype(np.float32))
        out = {c: one.column(c).take(pa.array(np.zeros(len(r), np.int64))) for c in batch}
        out |= {c: one.column(c).take(pa.array(first_row[r])) for c in free_left}
        out |= {name: other.column(name).take(pa.array(first_column[c])) for name in free_right}
        return pa.table(out | {"_v": pa.array(made[r, c], pa.float64())})

    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *right.schema.fields]}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names[:-1]), "_v double"])
    return lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(run, schema)


def einsum(equation: str, *operands: tuple[DataFrame, list[str]], value: str = "x") -> DataFrame:
    """Sum of products over coordinate rows; absent coordinates are zeros.

    A missing value makes every sum that it enters NULL, as it does an infinite
    value times zero or less another.
    An operand is a table with its index columns, in order, and a value column.
    The result has a column i0, i1, ... for each index and the value.  Indices
    that only one operand has and the result lacks are summed before the join.
    Where two operands share summed indices and each has others, they are
    multiplied as dense tiles; rows with a null index take no part.  Operands without a common index make an outer product, as large as that is.
    """
    inputs, output = _subscripts(equation, [len(columns) for _, columns in operands])
    made: DataFrame | None = None
    have: list[str] = []
    for number, ((df, columns), names) in enumerate(zip(operands, inputs, strict=True)):
        same = F.lit(True)
        for k, name in enumerate(names):
            first = names.index(name)
            if first != k:
                same = same & (F.col(columns[k]) == F.col(columns[first]))
        own = list(dict.fromkeys(names))
        term = df.where(same).select(*(F.col(columns[names.index(n)]).alias(n) for n in own), F.coalesce(F.col(value).cast("double"), F.lit(math.nan)).alias(f"_v{number}"))
        elsewhere = {n for k, other in enumerate(inputs) if k != number for n in other} | set(output)
        kept = [n for n in own if n in elsewhere]
        if len(kept) < len(own):
            term = term.groupBy(*kept).agg(F.sum(f"_v{number}").alias(f"_v{number}"))
        if made is None:
            made, have = term.withColumnRenamed(f"_v{number}", "_v"), kept
            continue
        common = [n for n in kept if n in have]
        needed = set(output) | {n for other in inputs[number + 1 :] for n in other}
        summed = [n for n in common if n not in needed]
        if summed and len(kept) > len(common) and len(have) > len(common):
            # Both have indices of their own: a product of matrices.
            made = _tiled(made, term, [n for n in common if n in needed], summed, "_v", f"_v{number}")
            have = [n for n in [*have, *kept] if n in made.columns]
            have = list(dict.fromkeys(have))
            if number + 1 < len(operands):
                made = made.groupBy(*have).agg(F.sum("_v").alias("_v"))
            continue
        made = made.join(term, common) if common else made.crossJoin(term)
        made = made.withColumn("_v", F.col("_v") * F.col(f"_v{number}")).drop(f"_v{number}")
        have += [n for n in kept if n not in have]
        rest = [n for n in have if n in needed]
        if len(rest) < len(have) and number + 1 < len(operands):
            made, have = made.groupBy(*rest).agg(F.sum("_v").alias("_v")), rest
    if len(set(output)) < len(output) or not set(output) <= set(have):
        raise ValueError("the result names an index that no operand has, or one twice")
    # NaN stays NaN in products and sums, and becomes NULL at the end.
    total = made.groupBy(*output).agg(present(F.sum("_v")).alias(value)) if output else made.agg(present(F.sum("_v")).alias(value))
    return total.select(*(F.col(n).alias(f"i{k}") for k, n in enumerate(output)), value)


def project(a: tuple[DataFrame, list[str]], x: tuple[DataFrame, list[str]], value: str = "x") -> DataFrame:
    """x times a transposed: (..., O, I) and (..., S, I) give (..., S, O)."""
    return einsum("...oi,...si->...so", a, x, value=value)


def orthogonalize(df: DataFrame, x: str, y: str, keys: list[str], *, out: str = "orthogonal") -> DataFrame:
    """Adds x less its projection on y; NULL if y is zero."""
    group = Series(keys).group
    vx, vy = present(x), present(y)
    share = divide(F.sum(vx * vy).over(group), F.sum(vy * vy).over(group))
    return df.withColumn(out, vx - share * vy)


Matrix = tuple[str, str, str]


def _dense(table: pa.Table, row: str, column: str, value: str, square: bool) -> tuple[np.ndarray, list]:
    """The matrix, with zeros where there is no row and NaN where the value is missing, and the names of its rows."""
    r, c = table.column(row).to_numpy(), table.column(column).to_numpy()
    rows, at_row = np.unique(np.concatenate([r, c]) if square else r, return_inverse=True)
    columns, at_column = (rows, at_row[len(r) :]) if square else np.unique(c, return_inverse=True)
    matrix = np.zeros((len(rows), len(columns)))
    matrix[at_row[: len(r)], at_column] = table.column(value).to_numpy()
    return matrix, rows.tolist()


def _per_matrix(df: DataFrame, keys: list[str], names: Matrix, f: Callable[[np.ndarray, list], dict], fields: str, *, square: bool = True) -> DataFrame:
    """Applies f to each group's matrix; it returns columns of Python lists.  Rows without a row or column name are left out."""
    row, column, value = names
    rows = df.select(*keys, row, column, F.col(value).cast("double").alias(value)).dropna(subset=[row, column])

    def run(table):
        made = f(*_dense(table, row, column, value, square))
        n = len(next(iter(made.values())))
        first = table.slice(0, 1)
        return pa.table({k: pa.concat_arrays([first.column(k).combine_chunks()] * n) if n else first.column(k).slice(0, 0) for k in keys} | {k: pa.array(v, _KINDS.get(k, table.schema.field(row).type)) for k, v in made.items()})

    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), fields])
    return rows.groupBy(*keys).applyInArrow(run, schema)


_KINDS = {"k": pa.int64(), "eigenvalue": pa.float64(), "explained_variance": pa.float64(), **dict.fromkeys(("eigenvector", "component", "vector"), pa.list_(pa.float64()))}


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Rows with their largest entry (of equals the first) made positive: signs are free, so they are fixed."""
    at = np.argmax(np.round(np.abs(vectors), 9), axis=1)
    signs = np.sign(vectors[np.arange(len(vectors)), at])
    return vectors * np.where(signs == 0, 1.0, signs)[:, None]


def _symmetric(matrix: np.ndarray, lower: bool) -> tuple[list, list]:
    """Ascending eigenvalues and signed eigenvectors; None for all of them if the triangle that is read has a hole or an infinity."""
    if not np.isfinite(np.tril(matrix) if lower else np.triu(matrix)).all():
        return [None] * len(matrix), [None] * len(matrix)
    values, vectors = np.linalg.eigh(matrix, UPLO="L" if lower else "U")
    return values.tolist(), _signed(vectors.T).tolist()


def eigh(df: DataFrame, keys: list[str], names: Matrix = ("r", "c", "x"), *, lower: bool = True) -> DataFrame:
    """``keys, k, eigenvalue, eigenvector``: ascending; of the matrix only one triangle is read.

    Absent coordinates are zeros.  A missing or infinite value in the triangle
    makes all of the matrix's eigenvalues and eigenvectors NULL.
    """

    def f(matrix, rows):
        values, vectors = _symmetric(matrix, lower)
        return {"k": list(range(len(values))), "eigenvalue": values, "eigenvector": vectors}

    return _per_matrix(df, keys, names, f, "k bigint, eigenvalue double, eigenvector array<double>")


def orthonormalize(df: DataFrame, keys: list[str], names: Matrix = ("r", "c", "x")) -> DataFrame:
    """``keys, r, vector``: the rows of each matrix made orthonormal in order, as Gram and Schmidt do.

    Absent coordinates are zeros.  With a missing or infinite value all of the
    matrix's vectors are NULL.
    """

    def f(matrix, rows):
        if matrix.shape[0] > matrix.shape[1]:
            raise ValueError("more vectors than dimensions")
        if not np.isfinite(matrix).all():
            return {"r": rows, "vector": [None] * len(rows)}
        q, r = np.linalg.qr(matrix.T)
        signs = np.sign(np.diag(r))
        return {"r": rows, "vector": (q * np.where(signs == 0, 1.0, signs)[None, :]).T.tolist()}

    kind = df.schema[names[0]].dataType.simpleString()
    return _per_matrix(df, keys, names, f, f"r {kind}, vector array<double>", square=False)


def pca_cov(df: DataFrame, keys: list[str], names: Matrix = ("r", "c", "x")) -> DataFrame:
    """``keys, k, explained_variance, component`` of covariance matrices, by falling variance; NULL as in eigh."""

    def f(matrix, rows):
        values, vectors = _symmetric((matrix + matrix.T) / 2, True)
        return {"k": list(range(len(values))), "explained_variance": values[::-1], "component": vectors[::-1]}

    return _per_matrix(df, keys, names, f, "k bigint, explained_variance double, component array<double>")


def covariance(df: DataFrame, keys: list[str], section: str, dimension: str, value: str, *, skip_missing: bool, ddof: int = 1) -> DataFrame:
    """``keys, r, c, x``: covariances of each pair of dimensions over the sections both have rows for.

    A section's rows become one array over the group's dimensions, whose matrices
    of sums are added up in tasks: no row meets another in a join.  A section has
    one row of a dimension at most; rows with a null key, section or dimension
    are left out.
    """
    t = helper_names(df)
    rows = df.dropna(subset=[*keys, section, dimension]).select(*keys, F.col(section).alias(t("section")), F.col(dimension).alias(t("at")), F.coalesce(F.col(value).cast("double"), F.lit(math.nan)).alias(t("x")))
    names = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(t("at"))).alias(t("names")))
    sections = rows.groupBy(*keys, t("section")).agg(F.map_from_entries(F.collect_list(F.struct(t("at"), t("x")))).alias(t("map")))
    join = (lambda a: a.join(names, keys)) if keys else (lambda a: a.crossJoin(F.broadcast(names)))  # one row
    vectors = join(sections).select(*keys, F.transform(t("names"), lambda name: F.try_element_at(t("map"), name)).alias(t("vector")))
    found = join(_vector_covariance(vectors, keys, t("vector"), skip_missing, ddof))
    return found.select(*keys, F.get(t("names"), F.col("r")).alias("r"), F.get(t("names"), F.col("c")).alias("c"), "x")


def pair_sums(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, r, c, n, n_all, x, y, xy`` for each pair r >= c of an array column's coordinates.

    Over the rows that have both: their number, the sums of each and of the
    products; n_all counts rows with NaN too, but not those with a NULL or a
    shorter array.  Tasks add up whole matrices, so a row never meets itself in
    a join.  Rows with a missing key are left out.
    """
    own = helper_names(df)("vector")
    rows = df.select(*keys, F.col(vector).cast("array<double>").alias(own)).dropna(subset=[*keys, own])
    kinds = [rows.schema[k].dataType for k in keys]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [*map(to_arrow_type, kinds), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = [*keys, "r", "c", "n", "n_all", "x", "y", "xy"]
        sums: dict[tuple, np.ndarray] = {}

        def rows_of(key: tuple, total: np.ndarray) -> pa.RecordBatch:
            r, c = np.nonzero(np.tril(total[1]))
            n, n_all, x, xy = total[0][r, c], total[1][r, c], total[2], total[3][r, c]
            columns = [*([k] * len(r) for k in key), r, c, n.astype(np.int64), n_all.astype(np.int64), x[r, c], x[c, r], xy]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            vectors = batch.column(len(keys))
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            width = int(lengths.max(initial=0))
            there = np.arange(width) < lengths[:, None]
            values = np.full(there.shape, np.nan)
            flat = vectors.flatten()
            values[there] = flat.to_numpy(zero_copy_only=False)
            there[there] = flat.is_valid().to_numpy(zero_copy_only=False)
            tuples = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True)) or [()] * len(lengths)
            codes: dict[tuple, int] = {}
            of = np.array([codes.setdefault(k, len(codes)) for k in tuples], np.int64)
            for key, code in codes.items():
                v, t = values[of == code], there[of == code].astype(float)
                have = (~np.isnan(v)).astype(float)
                endless = np.isinf(v).astype(float)
                finite = np.where(np.isfinite(v), v, 0.0)
                xy = finite.T @ finite
                xy[(endless.T @ have + have.T @ endless) > 0] = np.nan
                made = np.stack([have.T @ have, t.T @ t, finite.T @ have, xy])
                old = sums.get(key)
                if old is not None and old.shape[1] != width:
                    most = max(old.shape[1], width)
                    old, made = (np.pad(a, ((0, 0), (0, most - a.shape[1]), (0, most - a.shape[1]))) for a in (old, made))
                sums[key] = made if old is None else old + made
            if sum(a.nbytes for a in sums.values()) > 64 << 20:
                yield from (rows_of(*item) for item in sums.items())
                sums = {}
        yield from (rows_of(*item) for item in sums.items())

    fields = [*(f"`{k}` {kind.simpleString()}" for k, kind in zip(keys, kinds, strict=True)), "r int, c int, n bigint, n_all bigint, x double, y double, xy double"]
    added = [F.sum(k).alias(k) for k in ("n", "n_all", "x", "y", "xy")]
    return rows.mapInArrow(run, ", ".join(fields)).groupBy(*keys, "r", "c").agg(*added)


def _both_triangles(half: DataFrame, keys: list[str]) -> DataFrame:
    at = helper_names(half)("at")
    both = F.when(F.col("r") > F.col("c"), F.array(F.struct("r", "c"), F.struct(F.col("c").alias("r"), F.col("r").alias("c")))).otherwise(F.array(F.struct("r", "c")))
    return half.select(*keys, F.explode(both).alias(at), "x").select(*keys, f"{at}.r", f"{at}.c", "x")


def gram_of_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, r, c, x``: sums of products of each pair of an array column's coordinates; missing ones are zeros."""
    return _both_triangles(pair_sums(df, keys, vector).select(*keys, "r", "c", F.col("xy").alias("x")), keys)


def covariance_of_vectors(df: DataFrame, keys: list[str], vector: str, *, skip_missing: bool, ddof: int = 1) -> DataFrame:
    """As covariance, of an array column's coordinates; NULL and NaN are missing, a shorter array has no row."""
    own = helper_names(df)("vector")
    holes = F.transform(F.col(vector).cast("array<double>"), lambda x: F.coalesce(x, F.lit(math.nan)))
    return _vector_covariance(df.select(*keys, holes.alias(own)), keys, own, skip_missing, ddof)


def _vector_covariance(df: DataFrame, keys: list[str], vector: str, skip_missing: bool, ddof: int) -> DataFrame:
    # Sums of products lose no digits once values are near zero; the shift itself cancels out.
    t = helper_names(df)
    cells = df.dropna(subset=keys).select(*keys, F.posexplode(vector).alias(t("at"), t("x")))
    mean = cells.groupBy(*keys, t("at")).agg(F.avg(present(t("x"))).alias(t("m")))
    mean = mean.withColumn(t("m"), F.when(F.abs(t("m")) < float("inf"), F.col(t("m"))).otherwise(0.0))
    means = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(t("at"), t("m")))), lambda s: s[t("m")]).alias(t("means")))
    # Shorter vectors stay so.
    near = F.transform(F.col(vector), lambda x, k: x - F.get(t("means"), k))
    joined = df.join(means, keys) if keys else df.crossJoin(F.broadcast(means))  # one row
    sums = pair_sums(joined.select(*keys, near.alias(t("near"))), keys, t("near"))
    value = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - ddof)
    enough = F.col("n") > ddof if skip_missing else (F.col("n") > ddof) & (F.col("n") == F.col("n_all"))
    return _both_triangles(sums.select(*keys, "r", "c", F.when(enough & (F.col("n") > 0), present(value)).alias("x")), keys)


def pca(df: DataFrame, keys: list[str], section: str, dimension: str, value: str) -> DataFrame:
    """Principal components of the sample covariance over sections; NULL for a group with a missing value."""
    return pca_cov(covariance(df, keys, section, dimension, value, skip_missing=False), keys)


def nanpca(df: DataFrame, keys: list[str], section: str, dimension: str, value: str) -> DataFrame:
    """Principal components of pairwise covariances; with missing values a variance may be negative.

    NULL for a group in which a pair of dimensions has fewer than two common rows.
    """
    return pca_cov(covariance(df, keys, section, dimension, value, skip_missing=True), keys)
