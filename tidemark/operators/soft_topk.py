"""Differentiable ranking as a transport of scores to two or three anchors.

A group's scores, standardised, are moved to the anchors at least squared cost
and smoothed by an entropy; the mass that the top anchor gets is the soft
membership.  soft_scores is the iteration for one list of scores; tables go
through rounds of aggregates, in which no group is ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import Series, helper_names, present
from ..steps import discard, saved


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def transport(scores: np.ndarray, anchors: np.ndarray, masses: np.ndarray, epsilon: float, max_iter: int) -> np.ndarray:
    """The smoothed plan between scores of equal mass and the anchors."""
    if epsilon <= 0:
        raise AssertionError("epsilon must be positive")
    if not np.isfinite(scores).all():
        raise ValueError("scores must be finite")
    n = len(scores)
    spread = scores.std(ddof=1) if n > 1 else 0.0
    standard = (scores - scores.mean()) / max(spread, 1e-6)
    cost = (standard[:, None] - anchors[None, :]) ** 2
    cost = cost / cost.max()
    log_rows, log_masses = np.full(n, -np.log(n)), np.log(np.maximum(masses, 1e-300))
    kernel, v = -cost / epsilon, np.zeros(len(anchors))
    for _ in range(max_iter):
        u = log_rows - _logsumexp(kernel + v[None, :], 1)
        v = log_masses - _logsumexp(kernel + u[:, None], 0)
    return np.exp(kernel + u[:, None] + v[None, :])


def soft_scores(scores: np.ndarray, k: int, *, bottom: bool, epsilon: float, max_iter: int) -> np.ndarray:
    n = len(scores)
    if bottom:
        if n < 2 * k:
            raise AssertionError("a group needs at least 2k scores")
        plan = transport(scores, np.array([-1.0, 0.0, 1.0]), np.array([k, n - 2 * k, k]) / n, epsilon, max_iter)
        return (plan[:, 2] - plan[:, 0]) * n
    if n < k:
        raise AssertionError("a group needs at least k scores")
    plan = transport(scores, np.array([-1.0, 1.0]), np.array([n - k, k]) / n, epsilon, max_iter)
    return plan[:, 1] * n


#: Moves of the potentials below which a group has come to rest.
STILL = 1e-12


def settle(kernel: np.ndarray, weight: np.ndarray, masses: np.ndarray, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Potentials before the last round and how far it moved them, for different scores and their shares of all."""
    before, moves = np.zeros(len(masses)), np.zeros(len(masses))
    wanted, log_weight = np.log(np.maximum(masses, 1e-300)), np.log(weight)[:, None]
    for _ in range(max_iter):
        before = before + moves
        pulls = kernel + before
        shares = pulls - _logsumexp(pulls, 1)[:, None]
        moves = wanted - np.maximum(_logsumexp(shares + log_weight, 0), -690.0)
        if np.abs(moves).max() < STILL:
            break
    return before, moves


class _Transport:
    """The iteration for all groups of a table at once.

    A group's state is one potential for each anchor, and its scores enter as
    different values with their counts.  Where those fill one part of bounded
    size, a task iterates over them by itself.  Larger groups are dealt to several
    parts and go through rounds: each adds up, for each group and anchor, the mass
    that the values send there, which needs no row to meet another.  A few rounds
    make one job, whose result, a row a group, is written.
    """

    #: Rounds of one job.
    TOGETHER = 5

    def __init__(self, scores: DataFrame, group: str, score: str, anchors: list[float], masses: list[Column], epsilon: float, max_iter: int, least: int, rows_per_part: int, t: Callable[[str], str]):
        """scores: rows of group (a struct, never null) and score (finite, never null)."""
        if epsilon <= 0:
            raise AssertionError("epsilon must be positive")
        self.anchors, self.epsilon, self.max_iter, self.group, self.t = anchors, epsilon, max_iter, group, t
        self.small = epsilon < 0.005
        ends = [F.abs(F.col(t(end)) - a) for end in ("low", "high") for a in anchors]
        stats = scores.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias(t("n")), F.avg(score).alias(t("mean")), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias(t("s")), F.min(score).alias(t("low")), F.max(score).alias(t("high")), F.approx_count_distinct(score).alias(t("different")))
        enough = F.when(F.col(t("n")) < least, F.raise_error(F.lit(f"a group needs at least {least} scores")).cast("double")).otherwise(F.col(t("n")))
        stats = stats.withColumn(t("n"), enough).withColumn(t("s"), F.greatest(t("s"), F.lit(1e-6)))
        stats = stats.withColumns({t(end): (F.col(t(end)) - F.col(t("mean"))) / F.col(t("s")) for end in ("low", "high")})
        # The largest squared cost lies at one of the ends.
        stats = stats.withColumn(t("most"), F.pow(F.greatest(*ends), F.lit(2.0)))
        self.scores, self.score = scores, score
        self.stats = saved(stats.select(group, *(t(c) for c in ("n", "mean", "s", "most")), F.array(*masses).alias(t("masses")), (1 + F.floor(F.col(t("different")) / rows_per_part)).cast("int").alias(t("parts"))))
    def kernel(self, score: Column, k: int) -> Column:
        standard = (score - F.col(self.t("mean"))) / F.col(self.t("s"))
        return F.pow(standard - self.anchors[k], F.lit(2.0)) / F.col(self.t("most")) / (-self.epsilon)

    def log_shares(self, kernels: list[Column]) -> list[Column]:
        """Logarithms of a score's shares of its mass, by the potentials as they were before the last move."""
        pulls = [kernel + F.get(self.t("before"), k) for k, kernel in enumerate(kernels)]
        top = F.greatest(*pulls)
        total = top + F.log(reduce(lambda a, b: a + b, (F.exp(p - top) for p in pulls)))
        return [p - total for p in pulls]

    def _round(self, state: DataFrame) -> DataFrame:
        """``group, before, moves, masses, parts``: the potentials used, and by how much each then moves."""
        t, n = self.t, range(len(self.anchors))
        # Potentials move once more before use: what was found in the last round.
        now = state.withColumn(t("before"), F.zip_with(t("before"), t("moves"), lambda a, b: a + b)).drop(t("moves"))
        # The state travels with the values it meets, so that rounds follow each other in one line of the plan.
        kept = [t(c) for c in ("before", "masses", "parts")]
        dealt = now.select(self.group, *kept, F.explode(F.sequence(F.lit(0), F.col(t("parts")) - 1)).alias(t("part")))
        met = self.values.join(dealt, [self.group, t("part")])
        shares = self.log_shares([F.col(t(f"kernel{k}")) for k in n])
        met = met.select(self.group, *kept, t("weight"), *(s.alias(t(f"share{k}")) for k, s in enumerate(shares)))
        if self.small:
            # Shares may underflow: each anchor's largest is taken off first.
            peaks = met.groupBy(self.group).agg(*(F.max(t(f"share{k}")).alias(t(f"peak{k}")) for k in n))
            met = met.join(peaks, self.group)
        else:
            met = met.withColumns({t(f"peak{k}"): F.lit(0.0) for k in n})
        # The logarithm of the mass that comes together at each anchor.
        came = [F.max(t(f"peak{k}")) + F.log(F.greatest(F.sum(F.col(t("weight")) * F.exp(F.col(t(f"share{k}")) - F.col(t(f"peak{k}")))), F.lit(1e-300))) for k in n]
        sums = met.groupBy(self.group).agg(F.array(*came).alias(t("came")), *(F.first(c).alias(c) for c in kept))
        moves = F.zip_with(t("masses"), t("came"), lambda mass, got: F.log(F.greatest(mass, F.lit(1e-300))) - got)
        return sums.select(self.group, t("before"), moves.alias(t("moves")), t("masses"), t("parts"))

    def _values(self, large: bool) -> DataFrame:
        """``group, part, weight, kernel0, kernel1 ...``, a row for each different score of small or large groups."""
        t = self.t
        stats = self.stats.where((F.col(t("parts")) > 1) if large else (F.col(t("parts")) == 1))
        part = F.pmod(F.xxhash64(self.score), F.col(t("parts"))).cast("int").alias(t("part"))
        values = self.scores.groupBy(self.group, self.score).agg(F.count(F.lit(1)).alias(t("times"))).join(stats, self.group)
        kernels = (self.kernel(F.col(self.score), k).alias(t(f"kernel{k}")) for k in range(len(self.anchors)))
        return values.select(self.group, part, (F.col(t("times")) / F.col(t("n"))).alias(t("weight")), F.col(t("masses")), *kernels)

    def _small(self) -> DataFrame:
        """``group, before, moves`` of groups of one part, each by a task."""
        values, names = self._values(False), [self.t(f"kernel{k}") for k in range(len(self.anchors))]
        group, masses, weight, before, moves = self.group, self.t("masses"), self.t("weight"), self.t("before"), self.t("moves")
        rounds = self.max_iter

        def run(table):
            columns = [table.column(c).to_numpy() for c in (weight, *names)]
            old, moved = settle(np.stack(columns[1:], axis=1), columns[0], np.array(table.column(masses)[0].as_py()), rounds)
            kinds = pa.list_(pa.float64())
            key = table.column(group).combine_chunks().slice(0, 1)
            key = pa.StructArray.from_arrays(key.flatten(), fields=[f.with_nullable(True) for f in key.type])
            return pa.table({group: key, before: pa.array([old.tolist()], kinds), moves: pa.array([moved.tolist()], kinds)})

        kind = values.schema[group].dataType.simpleString()
        return values.groupBy(group).applyInArrow(run, f"`{group}` {kind}, `{before}` array<double>, `{moves}` array<double>")

    def _large(self) -> DataFrame:
        """``group, before, moves`` of groups of several parts, in rounds over all of them at once."""
        t = self.t
        # Dealt once by group and part; states are dealt alike in each round.
        self.values = self._values(True).drop(t("masses")).repartition(self.group, t("part")).persist(StorageLevel.MEMORY_AND_DISK)
        zeros = F.transform(t("masses"), lambda m: F.lit(0.0))
        state = self.stats.where(F.col(t("parts")) > 1).select(self.group, zeros.alias(t("before")), zeros.alias(t("moves")), t("masses"), t("parts"))
        done, last = 0, None
        while done < self.max_iter:
            for _ in range(min(1 if self.small else self.TOGETHER, self.max_iter - done)):
                state, done = self._round(state), done + 1
            state = saved(state)
            if last is not None:
                discard(last)
            last = state
            if state.agg(F.max(F.array_max(F.transform(t("moves"), F.abs)))).first()[0] < STILL:
                break
        self.values.unpersist()
        return state.select(self.group, t("before"), t("moves"))

    def solved(self) -> DataFrame:
        """``group, n, mean, s, most, before, moves`` after max_iter rounds, or when all groups have come to rest."""
        states = self._small()
        if self.stats.where(F.col(self.t("parts")) > 1).limit(1).count():
            states = states.unionByName(self._large())
        return self.stats.drop(self.t("masses"), self.t("parts")).join(states, self.group)


def _ranked(df: DataFrame, x: str, k: int, series: Series, out: str, bottom: bool, epsilon: float, max_iter: int, rows_per_part: int) -> DataFrame:
    t = helper_names(df)
    score = F.col(t("score"))
    finite = F.when(F.abs(present(x)) == float("inf"), F.raise_error(F.lit("scores must be finite")).cast("double")).otherwise(present(x))
    # A struct of the keys is never null, and equal where keys are null alike.
    group = F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(series.keys)], F.lit(0).alias("one"))
    rows = df.select(*series.keys, *series.order_by, x, group.alias(t("group")), finite.alias(t("score")))
    n = F.col(t("n"))
    anchors = [-1.0, 0.0, 1.0] if bottom else [-1.0, 1.0]
    masses = [k / n, (n - 2 * k) / n, k / n] if bottom else [(n - k) / n, k / n]
    run = _Transport(rows.where(score.isNotNull()).select(t("group"), t("score")), t("group"), t("score"), anchors, masses, epsilon, max_iter, 2 * k if bottom else k, rows_per_part, t)
    solved = run.solved()
    joined = rows.join(solved, t("group"), "left")
    shares = run.log_shares([run.kernel(score, j) for j in range(len(anchors))])
    sent = [F.exp(s + F.get(t("moves"), j)) for j, s in enumerate(shares)]
    return joined.select(*series.keys, *series.order_by, x, (sent[-1] - sent[0] if bottom else sent[-1]).alias(out))


def soft_topk(df: DataFrame, x: str, k: int, series: Series, *, epsilon: float = 0.1, max_iter: int = 200, out: str = "soft_topk", rows_per_part: int = 1_000_000) -> DataFrame:
    """``keys, order, x`` and the soft membership of each score in its group's k largest; a group sums to k.

    Missing scores get NULL and don't count; a group of fewer than k scores and
    an infinite score are errors of the job.  A null key is a group like others.
    The iteration runs as Spark jobs over all groups at once when this is called,
    to its fixed point but for at most ``max_iter`` rounds; a group of more than
    ``rows_per_part`` different scores is dealt to several parts, so it may be of any size.
    """
    return _ranked(df, x, k, series, out, False, epsilon, max_iter, rows_per_part)


def soft_topk_bottomk(df: DataFrame, x: str, k: int, series: Series, *, epsilon: float = 0.1, max_iter: int = 200, out: str = "soft_topk_bottomk", rows_per_part: int = 1_000_000) -> DataFrame:
    """As soft_topk: soft membership in the k largest less that in the k smallest; groups need 2 k scores."""
    return _ranked(df, x, k, series, out, True, epsilon, max_iter, rows_per_part)
