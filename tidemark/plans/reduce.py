"""Reductions, statistics of two columns, grouping and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..series import Series
from ..sources import read_table
from .common import EVENTS, LINES, Query, events, lines, rounded, sql_rounded


def _by_user(make, digits: int = 6) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = make()
        made = made if isinstance(made, dict) else {"result": made}
        return events(spark, sf_dir).groupBy("user_id").agg(*(rounded(c, digits).alias(k) for k, c in made.items()))

    return query


def _sql(digits: int = 6, **columns: str) -> str:
    made = ", ".join(f"{sql_rounded(c, digits)} AS {k}" for k, c in columns.items())
    return f"WITH {EVENTS} SELECT user_id, {made} FROM e GROUP BY user_id"


def _by_supplier(make, digits: int = 4) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lines(spark, sf_dir).groupBy("l_suppkey").agg(*(rounded(c, digits).alias(k) for k, c in make().items()))

    return query


def _sql_pair(digits: int = 4, **columns: str) -> str:
    made = ", ".join(f"{sql_rounded(c, digits)} AS {k}" for k, c in columns.items())
    return f"WITH {LINES} SELECT l_suppkey, {made} FROM l GROUP BY l_suppkey"


#: Names of the two column pairs: q and p hold every value, x and y have holes.
Q, P = "l_quantity", "l_extendedprice"
NO_HOLE = "count(x) = count(*) AND count(y) = count(*)"
BOTH = "FILTER (x IS NOT NULL AND y IS NOT NULL)"


def _both(name: str):
    whole, skipping = getattr(fn, name), getattr(fn, f"nan{name}")
    return lambda: {"whole": whole(Q, P), "broken": whole("x", "y"), "skipping": skipping("x", "y")}


def keepdim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reduction that each row keeps."""
    group = Series(["user_id"]).group
    return events(spark, sf_dir).select("user_id", "event_id", rounded(fn.nanmean("x").over(group)).alias("result"))


def nansum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(rounded(fn.nansum("x"), 2).alias("result"))


def bincount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.bincount(read_table(spark, sf_dir, "part", ["p_brand", "p_size"]), "p_size", keys=["p_brand"], minlength=10)


def groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_size"])
    return op.group_rows(df, "p_size", Series([], ["p_partkey"])).select("p_partkey", "p_size", "slot")


def groupby_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    made = op.padded_groups(df, "c_acctbal", "c_nationkey", Series([], ["c_custkey"]), empty_value=0.0)
    return made.select("c_nationkey", F.size("values").alias("depth"), F.posexplode("values").alias("slot", "value"))


def stable_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    df = df.withColumn("x", F.when(F.col("c_custkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.floor("c_acctbal")))
    return op.stable_sort(df, "x", "c_custkey", Series(["c_nationkey"], ["c_custkey"]))


def signif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]).select("o_orderkey", fn.signif("o_totalprice", 3).alias("result"))


def _soft(f, name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read_table(spark, sf_dir, "customer", ["c_nationkey", "c_custkey", "c_acctbal"])
        return f(df, "c_acctbal", 1, Series(["c_nationkey"], ["c_custkey"]), out="result").select("c_nationkey", "c_custkey", rounded("result").alias("result"))

    query.__name__ = name
    return query


def stable_sort_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as one series, cut into ranges; lines of an order with the same quantity are alike."""
    return op.stable_sort(lines(spark, sf_dir).select("x", "l_orderkey"), "x", "l_orderkey", Series([], ["l_orderkey"]))


def soft_topk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds over all orders of each status, whose prices are dealt to parts."""
    df = read_table(spark, sf_dir, "orders", ["o_orderstatus", "o_orderkey", "o_totalprice"])
    made = op.soft_topk(df, "o_totalprice", 10, Series(["o_orderstatus"], ["o_orderkey"]), max_iter=10, rows_per_part=500, out="result")
    return made.select("o_orderstatus", "o_orderkey", rounded("result").alias("result"))


def soft_parts_sql() -> str:
    sql = soft_sql([-1.0, 1.0], ["(max(n) - 10) / max(n)", "10 / max(n)"], "p[2] * n", rounds=10)
    for a, b in {"c_nationkey": "o_orderstatus", "c_custkey": "o_orderkey", "c_acctbal": "o_totalprice", "FROM customer": "FROM orders"}.items():
        sql = sql.replace(a, b)
    return sql


def soft_sql(anchors: list[float], masses: list[str], result: str, epsilon: float = 0.1, rounds: int = 200) -> str:
    """The transport's iteration, each round a step of the recursion: a group's state is a number for each anchor."""
    n = range(1, len(anchors) + 1)
    cost = ", ".join(f"power((x - m) / greatest(s, 1e-6) - ({a!r}), 2)" for a in anchors)
    kernel = [f"kernel[{k}] + v[{k}]" for k in n]
    top = f"greatest({', '.join(kernel)})"
    u = f"-ln(n) - ({top} + ln({' + '.join(f'exp({x} - {top})' for x in kernel)}))"
    # Here the greatest of each column is taken off before summing too.
    steps = ", ".join(f"ln({mass}) - (max(kernel[{k}] + u) + ln(sum(exp(kernel[{k}] + u - t[{k}]))))" for k, mass in zip(n, masses, strict=True))
    tops = ", ".join(f"max(kernel[{k}] + u) OVER (PARTITION BY c_nationkey)" for k in n)
    return f"""WITH RECURSIVE g AS (
      SELECT c_nationkey, c_custkey, c_acctbal AS x, count(*) OVER w AS n, avg(c_acctbal) OVER w AS m, coalesce(stddev_samp(c_acctbal) OVER w, 0) AS s
      FROM customer WINDOW w AS (PARTITION BY c_nationkey)
    ), c AS (SELECT *, [{cost}] AS cost FROM g), k AS (
      SELECT c_nationkey, c_custkey, n::DOUBLE AS n, list_transform(cost, lambda y: -y / max(list_max(cost)) OVER (PARTITION BY c_nationkey) / {epsilon}) AS kernel FROM c
    ), state AS (
      SELECT c_nationkey, 0 AS i, list_transform({anchors!r}, lambda a: 0.0::DOUBLE) AS v FROM (SELECT DISTINCT c_nationkey FROM k)
      UNION ALL
      SELECT c_nationkey, min(i) + 1 AS i, [{steps}] AS v FROM (
        SELECT *, [{tops}] AS t FROM (SELECT k.*, i, {u} AS u FROM state JOIN k USING (c_nationkey) WHERE i < {rounds})
      ) GROUP BY c_nationkey
    ), last AS (SELECT k.*, v, before FROM k JOIN (SELECT c_nationkey, v FROM state WHERE i = {rounds}) USING (c_nationkey) JOIN (SELECT c_nationkey, v AS before FROM state WHERE i = {rounds - 1}) USING (c_nationkey)),
    plan AS (SELECT c_nationkey, c_custkey, n, list_transform(range({len(anchors)}), lambda j: exp(kernel[j + 1] + u + v[j + 1])) AS p FROM (SELECT * EXCLUDE (v, before), v, {u.replace('v[', 'before[')} AS u FROM last))
    SELECT c_nationkey, c_custkey, {sql_rounded(result)} AS result FROM plan"""


def _moments(flavour: str) -> str:
    return f"""WITH {EVENTS}, c AS (SELECT user_id, x - avg(x) OVER (PARTITION BY user_id) AS d FROM e WHERE x IS NOT NULL),
    m AS (SELECT user_id, count(*)::DOUBLE AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c GROUP BY user_id)
    SELECT user_id, {flavour} FROM m"""


PLANS: dict[str, tuple[Query, str | None]] = {
    "nansum": (_by_user(lambda: fn.nansum("x")), _sql(result="sum(x)")),
    "nansum_all": (nansum_all, f"WITH {EVENTS} SELECT {sql_rounded('sum(x)', 2)} AS result FROM e"),
    "nanmean": (_by_user(lambda: fn.nanmean("x")), _sql(result="avg(x)")),
    "nanmean_keepdim": (keepdim, f"WITH {EVENTS} SELECT user_id, event_id, {sql_rounded('avg(x) OVER (PARTITION BY user_id)')} AS result FROM e"),
    "nanvar": (_by_user(lambda: {"unbiased": fn.nanvar("x"), "biased": fn.nanvar("x", unbiased=False)}), _sql(unbiased="var_samp(x)", biased="var_pop(x)")),
    "nanskew": (
        _by_user(lambda: {"unbiased": fn.nanskew("x"), "biased": fn.nanskew("x", unbiased=False)}),
        _moments(f"{sql_rounded('m3 / power(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2)')} AS unbiased, {sql_rounded('m3 / power(m2, 1.5)')} AS biased"),
    ),
    "nankurtosis": (
        _by_user(lambda: {"unbiased": fn.nankurtosis("x"), "biased": fn.nankurtosis("x", unbiased=False), "pearson": fn.nankurtosis("x", fisher=False)}),
        _moments(
            f"{sql_rounded('((n + 1) * m4 / (m2 * m2) - 3 * (n - 1)) * (n - 1) / ((n - 2) * (n - 3))')} AS unbiased, {sql_rounded('m4 / (m2 * m2) - 3')} AS biased, {sql_rounded('(n + 1) * m4 / (m2 * m2) * (n - 1) / ((n - 2) * (n - 3))')} AS pearson"
        ),
    ),
    "nanmax": (_by_user(lambda: fn.nanmax("x", "event_id")), _sql(**{"values": "max(x)", "indices": "coalesce(-max({'v': x, 'p': -event_id}) FILTER (x IS NOT NULL)['p'], 0)"})),
    "nanmin": (_by_user(lambda: fn.nanmin("x", "event_id")), _sql(**{"values": "min(x)", "indices": "coalesce(min({'v': x, 'p': event_id}) FILTER (x IS NOT NULL)['p'], 0)"})),
    "rms": (_by_user(lambda: {"whole": fn.rms("value"), "broken": fn.rms("x")}), _sql(whole="sqrt(avg(value * value))", broken="CASE WHEN count(x) = count(*) THEN sqrt(avg(x * x)) END")),
    "mulsum": (_by_supplier(lambda: {"whole": fn.mulsum(Q, "l_discount"), "broken": fn.mulsum("x", "l_discount")}), _sql_pair(whole="sum(l_quantity * l_discount)", broken="CASE WHEN count(x) = count(*) THEN sum(x * l_discount) END")),
    "mulmean": (_by_supplier(lambda: {"whole": fn.mulmean(Q, "l_discount"), "ddof": fn.mulmean(Q, "l_discount", ddof=1)}), _sql_pair(whole="sum(l_quantity * l_discount) / count(*)", ddof="sum(l_quantity * l_discount) / nullif(count(*) - 1, 0)")),
    "nanmulsum": (_by_supplier(lambda: {"result": fn.nanmulsum("x", "l_discount")}), _sql_pair(result="sum(x * l_discount)")),
    "nanmulmean": (_by_supplier(lambda: {"result": fn.nanmulmean("x", "l_discount"), "ddof": fn.nanmulmean("x", "l_discount", ddof=1)}), _sql_pair(result="sum(x * l_discount) / nullif(count(x), 0)", ddof="sum(x * l_discount) / nullif(count(x) - 1, 0)")),
    "covar": (_by_supplier(lambda: {"whole": fn.covar(Q, P), "broken": fn.covar("x", "y")}, 2), _sql_pair(2, whole="covar_samp(l_quantity, l_extendedprice)", broken=f"CASE WHEN {NO_HOLE} THEN covar_samp(x, y) END")),
    "nancovar": (_by_supplier(lambda: {"sample": fn.nancovar("x", "y"), "population": fn.nancovar("x", "y", ddof=0)}, 2), _sql_pair(2, sample="covar_samp(x, y)", population="covar_pop(x, y)")),
    "correl": (_by_supplier(lambda: {"whole": fn.correl(Q, P), "broken": fn.correl("x", "y")}), _sql_pair(whole="CASE WHEN stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 THEN corr(l_quantity, l_extendedprice) END", broken=f"CASE WHEN {NO_HOLE} THEN corr(x, y) END")),
    "nancorrel": (_by_supplier(lambda: {"result": fn.nancorrel("x", "y")}), _sql_pair(result=f"CASE WHEN stddev_pop(x) {BOTH} > 0 AND stddev_pop(y) {BOTH} > 0 THEN corr(x, y) END")),
    "slope": (_by_supplier(lambda: {"whole": fn.slope(Q, P), "broken": fn.slope("x", "y")}), _sql_pair(whole="regr_slope(l_extendedprice, l_quantity)", broken=f"CASE WHEN {NO_HOLE} THEN regr_slope(y, x) END")),
    "nanslope": (_by_supplier(lambda: {"result": fn.nanslope("x", "y")}), _sql_pair(result="regr_slope(y, x)")),
    "bincount": (
        bincount,
        "WITH g AS (SELECT p_brand, s AS p_size FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest(range(greatest(max(p_size) + 1, 10))) AS s FROM part)), c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_size::BIGINT AS p_size, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (p_brand, p_size)",
    ),
    "groupby": (groupby, "SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS slot FROM part"),
    "groupby_padded": (
        groupby_padded,
        """WITH c AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS slot FROM customer),
        d AS (SELECT max(slot) + 1 AS depth, max(c_nationkey) AS last FROM c),
        g AS (SELECT n AS c_nationkey, depth, unnest(range(depth)) AS slot FROM (SELECT unnest(range(last + 1)) AS n, depth FROM d))
        SELECT c_nationkey::INT AS c_nationkey, depth::INT AS depth, slot::INT AS slot, coalesce(c_acctbal, 0.0) AS value FROM g LEFT JOIN c USING (c_nationkey, slot)""",
    ),
    "stable_sort": (
        stable_sort,
        """WITH c AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE floor(c_acctbal) END AS x FROM customer)
        SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY x NULLS LAST, c_custkey) - 1 AS place, x AS values, c_custkey AS indices FROM c""",
    ),
    "stable_sort_lines": (
        stable_sort_lines,
        f"WITH {LINES} SELECT row_number() OVER (ORDER BY x NULLS LAST, l_orderkey) - 1 AS place, x AS values, l_orderkey AS indices FROM l",
    ),
    "signif": (signif, "SELECT o_orderkey, round_even(o_totalprice * power(10.0, 3 - ceil(log10(abs(o_totalprice)))), 0) / power(10.0, 3 - ceil(log10(abs(o_totalprice)))) AS result FROM orders"),
    "soft_topk": (_soft(op.soft_topk, "soft_topk"), soft_sql([-1.0, 1.0], ["(max(n) - 1) / max(n)", "1 / max(n)"], "p[2] * n")),
    "soft_topk_parts": (soft_topk_parts, soft_parts_sql()),
    "soft_topk_bottomk": (_soft(op.soft_topk_bottomk, "soft_topk_bottomk"), soft_sql([-1.0, 0.0, 1.0], ["1 / max(n)", "(max(n) - 2) / max(n)", "1 / max(n)"], "(p[3] - p[1]) * n")),
}
