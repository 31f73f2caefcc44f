"""Moving windows, scans, shifts and fills: per user over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..series import Series
from .common import EVENTS, USER, Query, events, rounded, sql_rounded

ID = ["user_id", "event_id"]


def _columns(make, **names) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = make()
        made = made if isinstance(made, dict) else {"result": made}
        return events(spark, sf_dir).select(*ID, *(rounded(c).alias(k) for k, c in made.items()))

    return query


def _sql(windows: str, inner: str = "", **columns: str) -> str:
    """Selects columns over events; inner adds a step before."""
    source = f", s AS ({inner})" if inner else ""
    made = ", ".join(f"{sql_rounded(c)} AS {k}" for k, c in columns.items())
    return f"WITH {EVENTS}{source} SELECT user_id, event_id, {made} FROM {'s' if inner else 'e'} WINDOW {windows}"


BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"


def _trailing(k: int) -> str:
    return f"w AS ({BY_USER} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


UPTO = f"w AS ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SINCE = f"w AS ({BY_USER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _full(k: int, value: str) -> str:
    return f"CASE WHEN count(x) OVER w = {k} THEN {value} END"


def _stepped(make) -> Query:
    """For operators that take and give a table; the column is `result`."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(events(spark, sf_dir)).select(*ID, rounded("result").alias("result"))

    return query


def _long(make) -> Query:
    """The event table as one series, cut into blocks of 1,000 rows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "x")
        blocked = op.with_blocks(df, "event_id", [], rows_per_block=1000, slice_width=5000)
        made = make(blocked)
        results = [c for c in made.columns if c == "result" or c in ("values", "indices")]
        return made.select("event_id", *(rounded(c, 4).alias(c) for c in results))

    return query


def _long_sql(order: str = "event_id", **columns: str) -> str:
    made = ", ".join(f"{sql_rounded(c, 4)} AS {k}" for k, c in columns.items())
    return f"WITH {EVENTS} SELECT event_id, {made} FROM e WINDOW w AS (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ema_sql(alpha: float, adjust: bool = True) -> str:
    rate = 1 - alpha
    inner = f"SELECT *, row_number() OVER ({BY_USER}) - 1 AS i FROM e"
    weight = "1.0" if adjust else f"(CASE WHEN i = 0 THEN 1.0 ELSE {alpha} END)"
    top = f"sum(x * {weight} * power({1 / rate!r}::DOUBLE, i)) OVER w"
    bottom = f"sum(power({1 / rate!r}::DOUBLE, i)) OVER w" if adjust else f"power({1 / rate!r}::DOUBLE, i)"
    return _sql(UPTO, inner, result=f"CASE WHEN count(x) OVER w = i + 1 THEN {top} / {bottom} END")


def rsi_sql(span: int, use_sma: bool) -> str:
    value = "coalesce(100.0 * g / nullif(g + l, 0), 0)"
    steps = f"""d AS (SELECT *, row_number() OVER ({BY_USER}) - 1 AS i, value - lag(value) OVER ({BY_USER}) AS d FROM e),
    u AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM d)"""
    if use_sma:
        inner = f"SELECT *, sum(up) OVER w AS g, sum(down) OVER w AS l FROM u WINDOW w AS ({BY_USER} ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW)"
        return f"WITH {EVENTS}, {steps}, s AS ({inner}) SELECT user_id, event_id, {sql_rounded(f'CASE WHEN i >= {span} THEN {value} END')} AS result FROM s"
    grow = repr(1 / (1 - 1 / span))
    seeds = f"SELECT *, CASE WHEN i < {span} THEN 0 WHEN i = {span} THEN avg(up) OVER w ELSE up / {span} END AS a, CASE WHEN i < {span} THEN 0 WHEN i = {span} THEN avg(down) OVER w ELSE down / {span} END AS b FROM u WINDOW w AS ({BY_USER} ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW)"
    sums = f"SELECT *, sum(a * power({grow}::DOUBLE, i)) OVER w AS g, sum(b * power({grow}::DOUBLE, i)) OVER w AS l FROM seeded WINDOW w AS ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"WITH {EVENTS}, {steps}, seeded AS ({seeds}), s AS ({sums}) SELECT user_id, event_id, {sql_rounded(f'CASE WHEN i >= {span} THEN {value} END')} AS result FROM s"


def blur_sql(sigma: float) -> str:
    import math

    reach = max(1, math.ceil(9 * sigma))
    weights = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-reach, reach + 1), op.gaussian_weights(sigma, reach), strict=True))
    return f"""WITH {EVENTS}, n AS (SELECT user_id, event_id, x, row_number() OVER ({BY_USER}) AS i FROM e), k(o, w) AS (VALUES {weights})
    SELECT a.user_id, a.event_id, {sql_rounded('sum(b.x * w) / nullif(sum(CASE WHEN b.x IS NOT NULL THEN w END), 0)')} AS result
    FROM n a CROSS JOIN k LEFT JOIN n b ON b.user_id = a.user_id AND b.i = a.i + o GROUP BY a.user_id, a.event_id"""


def rci_sql(period: int) -> str:
    return f"""WITH {EVENTS}, n AS (SELECT user_id, event_id, x, row_number() OVER ({BY_USER}) AS i FROM e),
    p AS (SELECT a.user_id, a.event_id, a.i - b.i AS age, b.x FROM n a JOIN n b ON a.user_id = b.user_id AND b.i BETWEEN a.i - {period - 1} AND a.i),
    r AS (SELECT user_id, event_id, x, age, row_number() OVER (PARTITION BY user_id, event_id ORDER BY x DESC NULLS LAST, age) - 1 AS k FROM p)
    SELECT user_id, event_id, {sql_rounded(f'CASE WHEN count(x) = {period} THEN (1 - 6.0 * sum((age - k) * (age - k)) / {period * (period * period - 1)}) * 100 END')} AS result
    FROM r GROUP BY user_id, event_id"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of all users: days by users, with natural holes."""
    daily = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.sum("value").alias("x"))
    days, users = daily.select("day").distinct(), daily.select("user_id").distinct()
    grid = users.join(F.broadcast(days))  # a calendar: 366 rows a year
    return grid.join(daily, ["day", "user_id"], "left").withColumn("half", F.col("user_id") % 2)


PANEL = f"""{EVENTS}, daily AS (SELECT ts::DATE AS day, user_id, sum(value) AS x FROM e GROUP BY 1, 2),
  panel AS (SELECT day, user_id, x, user_id % 2 AS half FROM (SELECT DISTINCT day FROM daily) CROSS JOIN (SELECT DISTINCT user_id FROM daily) LEFT JOIN daily USING (day, user_id))"""


def reduce_nan_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reduce_nan_patterns(_panel(spark, sf_dir), "x", position="day", ref="half").select(F.col("day").cast("string").alias("day"), F.col("mask").cast("int").alias("mask"))


def group_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    mask = op.reduce_nan_patterns(panel, "x", position="day", ref="half")
    shifted = fn.group_shift("x", "mask", Series(["user_id"], ["day"]))
    return panel.join(mask, "day").select(F.col("day").cast("string").alias("day"), "user_id", rounded(shifted).alias("result"))


def shift_two_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = fn.shift("x", 1, Series(["user_id"], ["day"]))
    step = _panel(spark, sf_dir).withColumn("s", by_day)
    by_user = fn.shift("s", -1, Series(["day"], ["user_id"]))
    return step.select(F.col("day").cast("string").alias("day"), "user_id", rounded(by_user).alias("result"))


def cumcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = fn.cumcount("event_type", USER)
    return events(spark, sf_dir).select(*ID, count.alias("result"))


def skipna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moving mean over the present rows only."""
    made = op.skipna(events(spark, sf_dir), lambda series: fn.ma("x", 5, series), "x", series=USER, out="result")
    return made.select(*ID, rounded("result").alias("result"))


def skipna_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of the present values' square roots, by a function on values."""
    import numpy as np

    made = op.skipna_values(events(spark, sf_dir), lambda x: np.cumsum(np.sqrt(np.abs(x))), "x", series=USER, out="result")
    return made.select(*ID, rounded("result").alias("result"))


def apply_for_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second value of each user's series, in order, by a user function."""
    import pyarrow as pa

    def every_second(table: pa.Table) -> pa.Table:
        return table.take(list(range(0, table.num_rows, 2))).select(["user_id", "event_id", "value"])

    df = events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    return op.apply_for_axis(df, every_second, "user_id bigint, event_id bigint, value double", USER)


_COUNT = "count(x) OVER w = count(*) OVER w"

PLANS: dict[str, tuple[Query, str | None]] = {
    "msum": (_columns(lambda: fn.msum("x", 5, USER)), _sql(_trailing(5), result=_full(5, "sum(x) OVER w"))),
    "ma": (_columns(lambda: fn.ma("x", 5, USER)), _sql(_trailing(5), result=_full(5, "avg(x) OVER w"))),
    "mvar": (_columns(lambda: fn.mvar("x", 5, USER)), _sql(_trailing(5), result=_full(5, "var_samp(x) OVER w"))),
    "mstd": (_columns(lambda: fn.mstd("x", 5, USER, ddof=0)), _sql(_trailing(5), result=_full(5, "stddev_pop(x) OVER w"))),
    "mmax": (_columns(lambda: fn.mmax("x", 5, USER)), _sql(_trailing(5), result=f"CASE WHEN {_COUNT} THEN max(x) OVER w END")),
    "mmin": (_columns(lambda: fn.mmin("x", 5, USER)), _sql(_trailing(5), result=f"CASE WHEN {_COUNT} THEN min(x) OVER w END")),
    "bollinger_band": (
        _columns(lambda: fn.bollinger_band("value", USER)),
        _sql(_trailing(20), **{k: f"CASE WHEN count(value) OVER w = 20 THEN avg(value) OVER w {s} END" for k, s in {"upper": "+ 2 * stddev_pop(value) OVER w", "middle": "", "lower": "- 2 * stddev_pop(value) OVER w"}.items()}),
    ),
    "ema": (_stepped(lambda df: op.ema(df, "x", 0.1, USER, out="result")), ema_sql(0.1)),
    "ema_recursive": (_stepped(lambda df: op.ema(df, "x", 0.2, USER, adjust=False, out="result")), ema_sql(0.2, adjust=False)),
    "rsi": (_stepped(lambda df: op.rsi(df, "value", USER, out="result")), rsi_sql(14, False)),
    "rsi_sma": (_stepped(lambda df: op.rsi(df, "value", USER, use_sma=True, out="result")), rsi_sql(14, True)),
    "rci": (_columns(lambda: fn.rci("x", USER, 5)), rci_sql(5)),
    "gaussian_blur": (_stepped(lambda df: op.gaussian_blur(df, "x", 1.5, USER, out="result")), blur_sql(1.5)),
    "nancumsum": (_columns(lambda: fn.nancumsum("x", USER)), _sql(UPTO, result="CASE WHEN x IS NOT NULL THEN sum(x) OVER w END")),
    "nancumprod": (
        _columns(lambda: fn.nancumprod(F.col("x") / 50.0, USER)),
        _sql(UPTO, result="CASE WHEN x IS NOT NULL THEN product(x / 50.0) OVER w END"),
    ),
    "rcumsum": (_columns(lambda: fn.rcumsum("x", USER)), _sql(SINCE, result=f"CASE WHEN {_COUNT} THEN sum(x) OVER w END")),
    "rcummax": (
        _columns(lambda: fn.rcummax("value", "event_id", USER)),
        _sql(SINCE, **{"values": "max(value) OVER w", "indices": "(max({'v': value, 'p': -event_id}) OVER w).p * -1.0"}),
    ),
    "cumcount": (cumcount, f"WITH {EVENTS} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS result FROM e"),
    "shift": (_columns(lambda: {"back": fn.shift("x", 2, USER), "ahead": fn.shift("x", -3, USER)}), _sql(f"w AS ({BY_USER})", back="lag(x, 2) OVER w", ahead="lead(x, 3) OVER w")),
    "shift_two_axes": (
        shift_two_axes,
        f"WITH {PANEL}, s AS (SELECT day, user_id, lag(x) OVER (PARTITION BY user_id ORDER BY day) AS s FROM panel) SELECT day::VARCHAR AS day, user_id, {sql_rounded('lead(s) OVER (PARTITION BY day ORDER BY user_id)')} AS result FROM s",
    ),
    "nanshift": (
        _columns(lambda: fn.nanshift("x", USER, 2)),
        _sql("w AS (PARTITION BY user_id, x IS NULL ORDER BY ts, event_id)", result="CASE WHEN x IS NOT NULL THEN lag(x, 2) OVER w END"),
    ),
    "reduce_nan_patterns": (
        reduce_nan_patterns,
        f"WITH {PANEL}, r AS (SELECT day, half, bool_or(x IS NOT NULL) AS m FROM panel GROUP BY day, half) SELECT day::VARCHAR AS day, bool_and(m)::INT AS mask FROM r GROUP BY day",
    ),
    "group_shift": (
        group_shift,
        f"""WITH {PANEL}, r AS (SELECT day, half, bool_or(x IS NOT NULL) AS m FROM panel GROUP BY day, half), mask AS (SELECT day, bool_and(m) AS mask FROM r GROUP BY day)
        SELECT day::VARCHAR AS day, user_id, {sql_rounded('CASE WHEN mask THEN lag(x) OVER (PARTITION BY user_id, mask ORDER BY day) END')} AS result FROM panel JOIN mask USING (day)""",
    ),
    "ffill": (_columns(lambda: fn.ffill("x", USER)), _sql(UPTO, result="last_value(x IGNORE NULLS) OVER w")),
    "bfill": (_columns(lambda: fn.bfill("x", USER)), _sql(SINCE, result="first_value(x IGNORE NULLS) OVER w")),
    "fillna": (_columns(lambda: fn.fillna("x", -1.0)), _sql(UPTO, result="coalesce(x, -1)")),
    "nanones": (_columns(lambda: fn.nanones("x")), _sql(UPTO, result="CASE WHEN x IS NOT NULL THEN 1 END")),
    "skipna": (
        skipna,
        f"WITH {EVENTS} SELECT user_id, event_id, {sql_rounded('CASE WHEN x IS NOT NULL AND count(x) OVER w = 5 THEN avg(x) OVER w END')} AS result FROM e WINDOW w AS (PARTITION BY user_id, x IS NULL ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    ),
    "skipna_values": (skipna_values, _sql(UPTO, result="CASE WHEN x IS NOT NULL THEN sum(sqrt(abs(x))) OVER w END")),
    "apply_for_axis": (apply_for_axis, f"WITH {EVENTS} SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER ({BY_USER}) AS i FROM e) WHERE i % 2 = 1"),
    "msum_wide": (_stepped(lambda df: op.wide_msum(df, "value", 30, USER, out="result")), _sql(_trailing(30), result="CASE WHEN count(value) OVER w = 30 THEN sum(value) OVER w END")),
    "mmax_wide": (_stepped(lambda df: op.wide_mmax(df, "x", 30, USER, out="result")), _sql(_trailing(30), result=f"CASE WHEN {_COUNT} THEN max(x) OVER w END")),
    "msum_long_series": (
        _long(lambda df: op.trailing_in_blocks(df, lambda s: fn.msum("x", 5, s), 5, [], rows_per_block=1000, out="result")),
        f"WITH {EVENTS} SELECT event_id, {sql_rounded(_full(5, 'sum(x) OVER w'), 4)} AS result FROM e WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    ),
    "nancumsum_long_series": (
        _long(lambda df: op.cumulative_in_blocks(df, "x", [], out="result")),
        f"WITH {EVENTS} SELECT event_id, {sql_rounded('CASE WHEN x IS NOT NULL THEN sum(x) OVER w END', 4)} AS result FROM e WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    ),
    "nancumprod_long_series": (
        _long(lambda df: op.nancumprod_in_blocks(df, 1 + F.col("x") / 1e6, [], out="result")),
        _long_sql(result="CASE WHEN x IS NOT NULL THEN product(1 + x / 1e6) OVER w END"),
    ),
    "rcumsum_long_series": (_long(lambda df: op.rcumsum_in_blocks(df, "value", [], out="result")), _long_sql("event_id DESC", result="sum(value) OVER w")),
    "rcummax_long_series": (
        _long(lambda df: op.rcummax_in_blocks(df, "value", "event_id", [])),
        _long_sql("event_id DESC", **{"values": "max(value) OVER w", "indices": "-(max({'v': value, 'p': -event_id}) OVER w).p"}),
    ),
    "cumcount_long_series": (
        _long(lambda df: op.cumcount_in_blocks(df, "event_type", [], out="result")),
        f"WITH {EVENTS} SELECT event_id, {sql_rounded('row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1', 4)} AS result FROM e",
    ),
    "ffill_long_series": (_long(lambda df: op.ffill_in_blocks(df, "x", [], out="result")), _long_sql(result="last_value(x IGNORE NULLS) OVER w")),
    "bfill_long_series": (_long(lambda df: op.bfill_in_blocks(df, "x", [], out="result")), _long_sql("event_id DESC", result="last_value(x IGNORE NULLS) OVER w")),
    "ema_long_series": (
        _long(lambda df: op.ema_in_blocks(df, "value", 0.001, [], rows_per_block=1000, out="result")),
        # Weights of the distance, not of the place, which would overflow: of 40,000 rows before, the first weighs 1e-17.
        f"""WITH {EVENTS}, numbered AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM e),
        b AS (SELECT *, i // 500 AS b, i % 500 AS j FROM numbered),
        p AS (SELECT *, sum(value * power(0.999::DOUBLE, -j)) OVER (PARTITION BY b ORDER BY j ROWS UNBOUNDED PRECEDING) * power(0.999::DOUBLE, j) AS own FROM b),
        t AS (SELECT b, arg_max(own, j) AS left_over FROM p GROUP BY b),
        c AS (SELECT x.b, sum(y.left_over * power(0.999::DOUBLE, 500 * (x.b - 1 - y.b))) AS carried FROM t x JOIN t y ON y.b < x.b GROUP BY x.b)
        SELECT event_id, {sql_rounded('(own + coalesce(carried, 0) * power(0.999::DOUBLE, j + 1)) * 0.001 / (1 - power(0.999::DOUBLE, i + 1))', 4)} AS result FROM p LEFT JOIN c USING (b)""",
    ),
    "rsi_long_series": (
        _long(lambda df: op.rsi_in_blocks(df, "value", [], 14, rows_per_block=1000, out="result")),
        f"""WITH RECURSIVE {EVENTS}, v AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i, value - lag(value) OVER (ORDER BY event_id) AS d FROM e),
        s AS (SELECT avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM v WHERE i BETWEEN 1 AND 14),
        w AS (SELECT event_id, i, CASE WHEN i < 14 THEN 0 WHEN i = 14 THEN s.g ELSE greatest(d, 0) / 14 END AS a, CASE WHEN i < 14 THEN 0 WHEN i = 14 THEN s.l ELSE greatest(-d, 0) / 14 END AS b FROM v, s),
        r AS (SELECT x.event_id, x.i, sum(y.a * power(13 / 14::DOUBLE, x.i - y.i)) AS g, sum(y.b * power(13 / 14::DOUBLE, x.i - y.i)) AS l FROM w x JOIN w y ON y.i BETWEEN x.i - 600 AND x.i GROUP BY x.event_id, x.i)
        SELECT event_id, {sql_rounded('CASE WHEN i >= 14 THEN coalesce(100.0 * g / nullif(g + l, 0), 0) END', 4)} AS result FROM r""",
    ),
    "mvar_wide": (_stepped(lambda df: op.wide_mvar(df, "x", 30, USER, out="result")), _sql(_trailing(30), result=_full(30, "var_samp(x) OVER w"))),
    "mstd_wide": (_stepped(lambda df: op.wide_mstd(df, "value", 40, USER, ddof=0, out="result")), _sql(_trailing(40), result="CASE WHEN count(value) OVER w = 40 THEN stddev_pop(value) OVER w END")),
    "bollinger_band_wide": (
        lambda spark, sf_dir: op.wide_bollinger_band(events(spark, sf_dir), "value", USER, 30).select(*ID, *(rounded(c).alias(c) for c in ("upper", "middle", "lower"))),
        _sql(_trailing(30), **{k: f"CASE WHEN count(value) OVER w = 30 THEN avg(value) OVER w {s} END" for k, s in {"upper": "+ 2 * stddev_pop(value) OVER w", "middle": "", "lower": "- 2 * stddev_pop(value) OVER w"}.items()}),
    ),
    "rci_wide": (_stepped(lambda df: op.wide_rci(df, "value", USER, 40, out="result")), rci_sql(40).replace("event_id, x, row_number", "event_id, value AS x, row_number")),
    "gaussian_blur_wide": (_stepped(lambda df: op.wide_gaussian_blur(df, "x", 8.0, USER, out="result")), blur_sql(8.0)),
    "rci_long_series": (
        _long(lambda df: op.wide_rci(df, "value", Series([], ["_row"]), 25, row="_row", out="result")),
        f"""WITH {EVENTS}, n AS (SELECT event_id, value AS x, row_number() OVER (ORDER BY event_id) AS i FROM e),
        r AS (SELECT a.event_id, a.i, a.i - b.i AS age, row_number() OVER (PARTITION BY a.i ORDER BY b.x DESC, a.i - b.i) - 1 AS k FROM n a JOIN n b ON b.i BETWEEN a.i - 24 AND a.i)
        SELECT event_id, {sql_rounded('CASE WHEN count(*) = 25 THEN (1 - 6.0 * sum((age - k) * (age - k)) / 15600) * 100 END', 4)} AS result FROM r GROUP BY event_id""",
    ),
    "gaussian_blur_long_series": (
        _long(lambda df: op.wide_gaussian_blur(df, "x", 6.0, Series([], ["_row"]), row="_row", out="result")),
        blur_sql(6.0).replace("PARTITION BY user_id ORDER BY ts, event_id", "ORDER BY event_id").replace("b.user_id = a.user_id AND ", "").replace("SELECT a.user_id, a.event_id", "SELECT a.event_id").replace("GROUP BY a.user_id, a.event_id", "GROUP BY a.event_id").replace(", 6) + 0.0)", ", 4) + 0.0)"),
    ),
}
