"""The data model: long tables, series keys and order, and what counts as missing.

A tensor axis becomes an ordering of rows; all other axes become keys.  NaN and
NULL both mean missing and results are NULL; infinities are data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(x: ColumnLike) -> Column:
    """The value as a double, NULL where it is missing."""
    return F.nullif(as_column(x).cast("double"), F.lit(float("nan")))


def missing(x: ColumnLike) -> Column:
    """Whether a value of any type is NULL or, as a double or float, NaN.

    The type is a constant of the plan, so other types are only asked for NULL.
    A hash finds NaN without a cast that other types would not stand; equality confirms it.
    """
    x = as_column(x)
    nan = F.lit(float("nan"))
    hashed = F.xxhash64(x).isin(F.xxhash64(nan), F.xxhash64(nan.cast("float"))) & (x.cast("string") == "NaN")
    return x.isNull() | (F.typeof(x).isin("double", "float") & hashed)


def held(x: ColumnLike) -> Column:
    """The value in its own type, NULL where it is missing."""
    return F.when(~missing(x), as_column(x))


def join_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """a joined with b by keys, NULL equal to NULL; b's keys are renamed for it and dropped, its other names must be new."""
    taken = {c.lower() for c in [*a.columns, *b.columns]}
    names = {}
    for k in keys:
        name = f"_{k}"
        while name.lower() in taken:
            name = f"_{name}"
        names[k] = name
        taken.add(name.lower())
    other = b.select(*(F.col(c).alias(names.get(c, c)) for c in b.columns))
    condition = F.lit(True)
    for k, name in names.items():
        condition = condition & F.col(k).eqNullSafe(F.col(name))
    return a.join(other, condition, how).drop(*names.values())


def divide(a: Column, b: Column) -> Column:
    """NULL where the divisor is zero."""
    return F.try_divide(a, b)


def helper_names(df: DataFrame) -> Callable[[str], str]:
    """Names for an operator's own columns that none of the table's columns has."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return lambda name: prefix + name


@dataclass(frozen=True)
class Series:
    """Which rows make up a series, and their order.

    The order must be total within the keys: add a tie-breaker if need be.
    """

    keys: Sequence[str] = field(default_factory=tuple)
    order_by: Sequence[str] = field(default_factory=tuple)

    def _columns(self) -> tuple[list[Column], list[Column]]:
        return [F.col(k) for k in self.keys], [F.col(o) for o in self.order_by]

    @property
    def group(self) -> WindowSpec:
        """All rows of the series, unordered."""
        return Window.partitionBy(*self._columns()[0])

    @property
    def ordered(self) -> WindowSpec:
        keys, order = self._columns()
        return Window.partitionBy(*keys).orderBy(*order)

    def among(self, *more: ColumnLike) -> WindowSpec:
        """As ordered, with further partition columns."""
        keys, order = self._columns()
        return Window.partitionBy(*keys, *map(as_column, more)).orderBy(*order)

    def trailing(self, span: int) -> WindowSpec:
        return self.ordered.rowsBetween(-(span - 1), 0)

    @property
    def upto(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def since(self) -> WindowSpec:
        """From the end back to the row: read in falling order, a frame to the end isn't aggregated anew for each row."""
        keys, order = self._columns()
        return Window.partitionBy(*keys).orderBy(*(o.desc() for o in order)).rowsBetween(Window.unboundedPreceding, 0)


def checked_span(span: int) -> int:
    if span < 1:
        raise ValueError(f"span must be at least 1, not {span}")
    return span
