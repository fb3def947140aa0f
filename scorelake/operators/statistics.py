"""Paired comparison of models, resampling, structural agreement, fronts and costs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-12


def finite(value: Column) -> Column:
    """The value as a double, or null if it is no finite number."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def curve(df: DataFrame, *keys: str, value: str) -> DataFrame:
    """Mean, population deviation (0 for one run) and number of runs by key; null values don't count."""
    return df.groupBy(*keys).agg(
        F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.count(value).alias("runs")
    )


def weighted_nll(df: DataFrame, *keys: str, nll: str = "nll", n: str = "n_tokens") -> DataFrame:
    """Token-weighted NLL and its perplexity; rows without a score or a size don't count."""
    good = df.where(F.col(nll).isNotNull() & F.col(n).isNotNull())
    mean = F.sum(F.col(nll) * F.col(n)) / F.greatest(F.sum(n), F.lit(1))
    return good.groupBy(*keys).agg(F.sum(n).alias("n_tokens"), F.round(mean, 6).alias("nll"), F.round(F.exp(mean), 6).alias("perplexity"))


def work_means(df: DataFrame, *keys: str, value: str = "nll") -> DataFrame:
    """Repeats averaged per key before any inference; null keys are dropped."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(known & F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias(value))


def paired(means: DataFrame, model: str = "model", unit: str = "work", value: str = "nll") -> DataFrame:
    """``(model_a, model_b, unit, difference)`` for every two models and every unit both have."""
    a = means.select(F.col(model).alias("model_a"), unit, F.col(value).alias("a"))
    b = means.select(F.col(model).alias("model_b"), unit, F.col(value).alias("b"))
    return a.join(b, unit).where("model_a < model_b").select("model_a", "model_b", unit, (F.col("a") - F.col("b")).alias("difference"))


def paired_summary(differences: DataFrame) -> DataFrame:
    """Number, mean, median and 2.5/97.5 percentiles of the differences of each pair."""
    q = lambda p: F.round(F.percentile("difference", p), 6)
    return differences.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("difference"), 6).alias("mean"), q(0.5).alias("median"),
        q(0.025).alias("low"), q(0.975).alias("high"),
    )


def signed_ranks(differences: DataFrame) -> DataFrame:
    """Average ranks of the absolute non-zero differences of each pair."""
    by = Window.partitionBy("model_a", "model_b").orderBy(F.abs(F.round("difference", 12)))
    ties = Window.partitionBy("model_a", "model_b", F.abs(F.round("difference", 12)))
    return differences.where(F.round("difference", 12) != 0).withColumn("rank", F.rank().over(by) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def rank_sum_counts(n: int) -> np.ndarray:
    """How many subsets of the ranks 1..n have each sum."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[: len(ways) - rank]
    return ways


def wilcoxon_p(w: float, n: int, ties: float, exact_to: int = 50) -> float | None:
    """Two-sided p of the smaller signed-rank sum.

    Up to ``exact_to`` differences without ties the law itself (each sign falls either way);
    else the normal approximation with tie correction.
    """
    if n < 2:
        return None
    if n <= exact_to and ties == 0:
        ways = rank_sum_counts(n)
        return float(min(1.0, 2.0 * ways[: int(w) + 1].sum() / 2.0**n))
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    if variance <= 0:
        return None
    return min(1.0, math.erfc(abs(w - n * (n + 1) / 4.0) / math.sqrt(2.0 * variance)))


def wilcoxon(differences: DataFrame) -> DataFrame:
    """``(model_a, model_b, n_nonzero, w_plus, w_minus, statistic, p_value)`` by the signed-rank test.

    Zero differences are left out; fewer than two others give no p. Ranks come from counts of
    equal absolute differences, so a pair of models with very many units is not ranked in one
    task. The p is exact for up to 50 differences without ties or zeros.
    """
    rows = differences.where("difference is not null").withColumn("r", F.round("difference", 12))
    other = F.col("r") != 0
    counts = rows.groupBy("model_a", "model_b", F.abs("r").alias("size")).agg(
        F.count_if(other).alias("n"), F.count_if(F.col("r") > 0).alias("n_plus"), F.count_if(~other).alias("zeros")
    )
    before = Window.partitionBy("model_a", "model_b").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2.0)
    total = ranked.groupBy("model_a", "model_b").agg(
        F.sum("n").alias("n_nonzero"), F.sum(F.col("rank") * F.col("n_plus")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("n") - F.col("n_plus"))).alias("w_minus"),
        F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"), F.sum("zeros").alias("zeros"),
    )

    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_p(a, int(b), c, 0 if z else 50) for a, b, c, z in zip(w, n, ties, zeros)], dtype="float64")

    return (
        total.where("n_nonzero > 0")
        .withColumn("statistic", F.least("w_plus", "w_minus"))
        .withColumn("p_value", p("statistic", "n_nonzero", "ties", "zeros"))
        .drop("ties", "zeros")
    )


def holm(df: DataFrame, p: str, *order: str) -> DataFrame:
    """Adds ``holm``: step-down adjusted p, cumulative maximum, at most 1. The family is a small table of pairs."""
    by = Window.orderBy(p, *order)
    n = df.where(F.col(p).isNotNull()).count()
    step = F.col(p) * (F.lit(n) - F.row_number().over(by) + 1)
    adjusted = df.where(F.col(p).isNotNull()).withColumn("step", step).withColumn("holm", F.least(F.lit(1.0), F.max("step").over(by))).drop("step")
    return adjusted.unionByName(df.where(F.col(p).isNull()).withColumn("holm", F.lit(None).cast("double")))


def bootstrap(differences: DataFrame, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean of each pair's differences, by resampling with replacement.

    Draw i of resample b takes the unit number md5(seed, b, i) mod n, the same in any engine.
    Draws are hashed where they are used and never shuffled: what moves is each pair's values (one
    row), once for each of some sixty groups of resamples; pairs in a task share the hashes.
    """
    values = F.transform(F.sort_array(F.collect_list(F.struct("work", "difference"))), lambda x: x["difference"])
    at_once = max(4, -(-resamples // 64))
    dealt = (
        differences.groupBy("model_a", "model_b").agg(values.alias("values"))
        .withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(at_once)))).repartition("first").sortWithinPartitions("first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}  # the hashes of the resamples of one group
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, x, first = batch.slice(k, 1).columns
                x, begin = x.flatten().to_numpy(zero_copy_only=False), first[0].as_py()
                if begin != now:
                    now, known = begin, {}
                means = []
                for r in range(begin, min(begin + at_once, resamples)):
                    have = known.get(r, np.empty(0, np.uint32))
                    if len(have) < len(x):
                        start = md5(f"{seed}:{r}:".encode())
                        known[r] = have = np.r_[have, [hashed(start, i) for i in range(len(have), len(x))]].astype(np.uint32)
                    means.append(float(x[have[: len(x)] % len(x)].mean()))
                yield pa.RecordBatch.from_arrays([pa.array(a.to_pylist() * len(means)), pa.array(b.to_pylist() * len(means)), pa.array(means, pa.float64())], ["model_a", "model_b", "mean"])

    means = dealt.select("model_a", "model_b", "values", "first").mapInArrow(run, "model_a string, model_b string, mean double")
    return means.groupBy("model_a", "model_b").agg(
        F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.975), 6).alias("high")
    )


def hashed(start, draw: int) -> int:
    """The first 32 bits of an md5 begun with ``start``."""
    h = start.copy()
    h.update(b"%d" % draw)
    return int.from_bytes(h.digest()[:4], "big")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, n)``; rows with a null label don't count."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(n, nmi, ari)`` of two labellings, from the contingency table alone.

    NMI is normalised by the mean entropy, 1 if both are trivial; ARI with a vanishing
    denominator is 1 if the partitions are equivalent, else 0; both are clamped.
    """
    cells = contingency(df, a, b)
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("total"))
    pairs = lambda c: c * (c - 1) / 2.0
    joint = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))
    p = F.col("n") / F.col("total")
    m = joint.agg(
        F.sum(p * F.ln(F.col("n") * F.col("total") / (F.col("ra") * F.col("cb")))).alias("mi"), F.sum(pairs(F.col("n"))).alias("index"),
        F.max("total").alias("n"), F.count(F.lit(1)).alias("cells"),
    )
    x = rows.crossJoin(F.broadcast(total)).agg(F.sum(-F.col("ra") / F.col("total") * F.ln(F.col("ra") / F.col("total"))).alias("ha"), F.sum(pairs(F.col("ra"))).alias("pa"), F.count(F.lit(1)).alias("na"))
    y = cols.crossJoin(F.broadcast(total)).agg(F.sum(-F.col("cb") / F.col("total") * F.ln(F.col("cb") / F.col("total"))).alias("hb"), F.sum(pairs(F.col("cb"))).alias("pb"), F.count(F.lit(1)).alias("nb"))
    one = m.crossJoin(x).crossJoin(y)  # one row each
    h = (F.col("ha") + F.col("hb")) / 2
    expected = F.try_divide(F.col("pa") * F.col("pb"), pairs(F.col("n")))
    bottom = (F.col("pa") + F.col("pb")) / 2 - F.coalesce(expected, F.lit(0.0))
    same = (F.col("cells") == F.col("na")) & (F.col("cells") == F.col("nb"))
    clamp = lambda c, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), c))
    return one.where("n is not null").select(
        "n", F.round(F.when(h <= FLOOR, 1.0).otherwise(clamp(F.col("mi") / h, 0.0)), 6).alias("nmi"),
        F.round(F.when(F.abs(bottom) <= FLOOR, F.when(same, 1.0).otherwise(0.0)).otherwise(clamp((F.col("index") - F.coalesce(expected, F.lit(0.0))) / bottom, -1.0)), 6).alias("ari"),
    )


def match_boundaries(reference: list[int], predicted: list[int], tolerance: int) -> int:
    """Most one-to-one matches within the tolerance: two pointers over sorted boundaries."""
    a, b, i, j, n = sorted(reference), sorted(predicted), 0, 0, 0
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tolerance:
            n, i, j = n + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return n


def boundary_scores(df: DataFrame, key: str, reference: str, predicted: str, tolerance: int = 0, digits: int = 6) -> DataFrame:
    """``(key, n_match, precision, recall, f1)``.

    Precision is 1 where nothing was predicted and recall 1 where the reference has no boundary,
    each on its own; F1 is their harmonic mean, 0 if both are 0.
    """
    if tolerance == 0:
        n = F.size(F.array_intersect(reference, predicted))
    else:

        @F.pandas_udf("int")
        def matches(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([match_boundaries(list(x), list(y), tolerance) for x, y in zip(a, b)], dtype="int32")

        n = matches(reference, predicted)
    ratio = lambda of: F.coalesce(F.try_divide("n_match", F.size(of)), F.lit(1.0))
    precision, recall = F.col("precision"), F.col("recall")
    return df.withColumn("n_match", n).withColumns({"precision": ratio(predicted), "recall": ratio(reference)}).select(
        key, "n_match", F.round(precision, digits).alias("precision"), F.round(recall, digits).alias("recall"),
        F.round(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), digits).alias("f1"),
    )


def pareto_front(df: DataFrame, minimize: list[str], maximize: list[str] = ()) -> DataFrame:
    """Rows no other row dominates; a row with a missing axis is comparable to none; equal rows all stay.

    For tables of models, whose size does not grow with the data: an anti-join on inequalities.
    """
    axes = [*minimize, *maximize]
    good = [finite(F.col(c)) for c in axes]
    rows = df.withColumns({f"_{c}": g for c, g in zip(axes, good)})
    other = rows.select(*[F.col(f"_{c}").alias(f"o_{c}") for c in axes])
    no_worse = [F.col(f"o_{c}") <= F.col(f"_{c}") for c in minimize] + [F.col(f"o_{c}") >= F.col(f"_{c}") for c in maximize]
    better = [F.col(f"o_{c}") < F.col(f"_{c}") for c in minimize] + [F.col(f"o_{c}") > F.col(f"_{c}") for c in maximize]
    beaten = reduce(lambda a, b: a & b, no_worse) & reduce(lambda a, b: a | b, better)
    return rows.join(other, beaten, "left_anti").drop(*[f"_{c}" for c in axes])


def two_axis_front(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The front of two minimised axes for tables of any size: best y up to each x, from a map-side minimum per x."""
    best = df.groupBy(x).agg(F.min(y).alias("best"))
    # ranges of x, their minima, then a running minimum inside each range: no single sorted task over all rows
    bounds = best.approxQuantile(x, [i / 16 for i in range(1, 16)], 0.01) if not best.isEmpty() else []
    slot = F.lit(0)
    for b in sorted(set(bounds)):
        slot = slot + (F.col(x) > b).cast("int")
    placed = best.withColumn("slot", slot)
    floor = placed.groupBy("slot").agg(F.min("best").alias("floor"))
    earlier = F.min("floor").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    floor = floor.select("slot", earlier.alias("earlier"))
    inside = F.min("best").over(Window.partitionBy("slot").orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    front = placed.join(F.broadcast(floor), "slot").withColumn("before", F.least(inside, F.col("earlier"))).where(
        F.col("before").isNull() | (F.col("best") < F.col("before"))
    )
    return df.join(front.select(x, F.col("best").alias(y)), [x, y], "left_semi").select(key, x, y)


def lag_one(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Lag-one autocorrelation around the mean of the whole series; null below three values or without variance."""
    by = Window.partitionBy(key)
    centred = df.where(finite(F.col(value)).isNotNull()).withColumn("c", F.col(value) - F.avg(value).over(by))
    rows = centred.withColumn("before", F.lag("c").over(by.orderBy(order)))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.when((F.count(F.lit(1)) >= 3) & (F.sum(F.col("c") * F.col("c")) > 0), F.sum(F.col("c") * F.col("before")) / F.sum(F.col("c") * F.col("c"))), 6).alias("lag_one"),
    )


def drift(df: DataFrame, key: str, order: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """Means of the early and late half of each finite series, their difference and whether it is small."""
    by = Window.partitionBy(key)
    rows = df.where(finite(F.col(value)).isNotNull()).withColumn("p", F.row_number().over(by.orderBy(order))).withColumn("n", F.count(F.lit(1)).over(by))
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    means = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("p") <= half, F.col(value))).alias("early"), F.avg(F.when(F.col("p") > half, F.col(value))).alias("late")
    )
    scale = F.greatest(F.abs("early"), F.abs("late"), F.lit(1.0))
    return means.select(
        key, "n", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"), F.round(F.col("late") - F.col("early"), 6).alias("drift"),
        (F.abs(F.col("late") - F.col("early")) <= tolerance * scale).alias("stable"),
    )


def chain_verdict(chains: DataFrame, least: int = 50, tolerance: float = 0.02, states: float = 1.0) -> DataFrame:
    """One row: the verdict on chains given as ``(n, late, stable)``, never a claim of convergence.

    Chains may also give ``late_active``, the mean number of active states of their later half;
    chains disagree if these lie more than ``states`` apart, or their late values more than
    ``tolerance`` of the largest.
    """
    spread, scale = F.max("late") - F.min("late"), F.max(F.abs("late"))
    n = F.count(F.lit(1))
    agree = F.coalesce(spread <= tolerance * F.when(scale == 0, 1.0).otherwise(scale), F.lit(True))
    known = "late_active" in chains.columns
    active = (F.max("late_active") - F.min("late_active")) if known else F.lit(None).cast("double")
    same = F.coalesce(active <= states, F.lit(True))
    verdict = (
        F.when(n == 0, "no_evidence").when(F.coalesce(F.min("n"), F.lit(0)) < least, "chains_too_short").when(~F.coalesce(F.bool_and("stable"), F.lit(True)), "drift_detected")
        .when((n > 1) & ~(agree & same), "chains_disagree").when(n < 2, "single_chain_no_cross_chain_evidence").otherwise("stable_within_the_observed_window")
    )
    columns = [n.alias("n_chains"), F.round(spread, 6).alias("spread"), verdict.alias("verdict")]
    return chains.agg(*columns, *([F.round(active, 6).alias("active_spread")] if known else []))
