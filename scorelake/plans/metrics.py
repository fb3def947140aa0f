"""Queries on scores of models: aggregates, paired statistics, audits, costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.operators import statistics as T
from scorelake.operators.quality import denominators, reconcile
from scorelake.operators.sampling import order_statistics
from scorelake.operators.sequences import best_so_far
from scorelake.plans.common import Catalogue
from scorelake.sources.relations import METRICS_SQL, RECORDS_SQL, metrics, records
from scorelake.sources.tables import table

C = Catalogue()
M = f"WITH {METRICS_SQL} "
#: One run for each model, fraction and seeds, as the published tables have it.
RUNS_SQL = f"""WITH {METRICS_SQL}, runs AS (
  SELECT model, frac, data_seed, model_seed, split_seed, sum(nll * n_tokens) / greatest(sum(CASE WHEN nll IS NOT NULL THEN n_tokens END), 1) AS test_nll,
         CAST(sum(CASE WHEN nll IS NOT NULL THEN n_tokens END) AS BIGINT) AS n_tokens, count(*) AS n_rows
  FROM metrics WHERE model IS NOT NULL GROUP BY ALL)"""
WORKS_SQL = f"WITH {METRICS_SQL}, means AS (SELECT model, work, avg(nll) AS nll FROM metrics WHERE model IS NOT NULL AND work IS NOT NULL AND nll IS NOT NULL AND frac = 1.0 GROUP BY ALL)"
DIFF_SQL = WORKS_SQL + """, diff AS (SELECT a.model AS model_a, b.model AS model_b, a.work, a.nll - b.nll AS difference FROM means a JOIN means b ON a.work = b.work AND a.model < b.model)"""


def runs(spark, d):
    """One row per model, fraction and seeds: token-weighted NLL of the run."""
    good = F.col("nll").isNotNull()
    return metrics(spark, d).where("model is not null").groupBy("model", "frac", "data_seed", "model_seed", "split_seed").agg(
        (F.sum(F.col("nll") * F.col("n_tokens")) / F.greatest(F.sum(F.when(good, F.col("n_tokens"))), F.lit(1))).alias("test_nll"),
        F.sum(F.when(good, F.col("n_tokens"))).alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"),
    )


def work_means(spark, d):
    return T.work_means(metrics(spark, d).where("frac = 1.0"), "model", "work")


def differences(spark, d):
    return T.paired(work_means(spark, d))


@C.add("agg02_means", M + "SELECT model, round(avg(nll), 6) AS nll, round(avg(n_tokens), 6) AS n_tokens, round(avg(frac), 6) AS frac FROM metrics WHERE model IS NOT NULL GROUP BY 1")
def agg02(spark, d):
    return metrics(spark, d).where("model is not null").groupBy("model").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("nll", "n_tokens", "frac")])


@C.add("agg03_curve", RUNS_SQL + " SELECT model, frac, round(avg(test_nll), 6) AS mean, round(stddev_pop(test_nll), 6) AS std, count(test_nll) AS runs FROM runs GROUP BY 1, 2")
def agg03(spark, d):
    return T.curve(runs(spark, d), "model", "frac", value="test_nll")


@C.add("agg04_weighted_nll", M + """, g AS (SELECT * FROM metrics WHERE nll IS NOT NULL AND n_tokens IS NOT NULL)
  SELECT model, frac, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, round(sum(nll * n_tokens) / greatest(sum(n_tokens), 1), 6) AS nll, round(exp(sum(nll * n_tokens) / greatest(sum(n_tokens), 1)), 6) AS perplexity FROM g GROUP BY 1, 2""")
def agg04(spark, d):
    return T.weighted_nll(metrics(spark, d), "model", "frac")


@C.add("agg05_length_slices", M + """, g AS (SELECT *, CASE WHEN n_tokens < 64 THEN 'short' WHEN n_tokens < 192 THEN 'medium' WHEN n_tokens < 512 THEN 'long' ELSE 'very_long' END AS slice FROM metrics WHERE nll IS NOT NULL AND n_tokens IS NOT NULL AND model IS NOT NULL)
  SELECT model, slice, count(*) AS n_pieces, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, round(sum(nll * n_tokens) / sum(n_tokens), 6) AS nll FROM g GROUP BY 1, 2""")
def agg05(spark, d):
    """Scores by length of the piece."""
    n = F.col("n_tokens")
    size = F.when(n < 64, "short").when(n < 192, "medium").when(n < 512, "long").otherwise("very_long")
    return metrics(spark, d).where("nll is not null and n_tokens is not null and model is not null").withColumn("slice", size).groupBy("model", "slice").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum(F.col("nll") * n) / F.sum(n), 6).alias("nll")
    )


@C.add("agg12_distinct_counts", M + "SELECT count(DISTINCT piece_id) AS n_pieces, count(DISTINCT work) AS n_works, count(DISTINCT model) AS n_models, count(DISTINCT frac) AS n_fractions, count(DISTINCT data_seed) AS n_data_seeds, count(DISTINCT model_seed) AS n_model_seeds FROM metrics")
def agg12(spark, d):
    """Distinct values by two-level aggregation, one pass for each column."""
    return metrics(spark, d).agg(
        *[F.countDistinct(c).alias(n) for c, n in (("piece_id", "n_pieces"), ("work", "n_works"), ("model", "n_models"), ("frac", "n_fractions"), ("data_seed", "n_data_seeds"), ("model_seed", "n_model_seeds"))]
    )


@C.add("agg14_split_variation", M + """, w AS (SELECT model, split_seed, work, avg(nll) AS nll FROM metrics WHERE model IS NOT NULL AND work IS NOT NULL AND nll IS NOT NULL GROUP BY ALL),
  s AS (SELECT model, split_seed, avg(nll) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(nll) END AS inside FROM w GROUP BY ALL)
  SELECT model, count(*) AS n_splits, round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS between_splits, round(avg(inside), 6) AS within_splits FROM s GROUP BY 1""")
def agg14(spark, d):
    """Nested means: variation of works inside a split and between splits."""
    good = metrics(spark, d).where("model is not null and work is not null and nll is not null")
    w = good.groupBy("model", "split_seed", "work").agg(F.avg("nll").alias("nll"))
    s = w.groupBy("model", "split_seed").agg(F.avg("nll").alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop("nll")).alias("inside"))
    return s.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_splits"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.stddev_pop("mean"), 6).alias("between_splits"), F.round(F.avg("inside"), 6).alias("within_splits")
    )


@C.add("agg15_work_means", WORKS_SQL + " SELECT model, work, round(nll, 8) AS nll FROM means")
def agg15(spark, d):
    return work_means(spark, d).select("model", "work", F.round("nll", 8).alias("nll"))


@C.add("jon03_paired_works", DIFF_SQL + " SELECT model_a, model_b, work, round(difference, 8) AS difference FROM diff")
def jon03(spark, d):
    return differences(spark, d).select("model_a", "model_b", "work", F.round("difference", 8).alias("difference"))


@C.add("hlp10_empty_pairs", WORKS_SQL + """, m AS (SELECT DISTINCT model FROM metrics WHERE model IS NOT NULL), p AS (SELECT a.model AS model_a, b.model AS model_b FROM m a JOIN m b ON a.model < b.model),
  n AS (SELECT a.model AS model_a, b.model AS model_b, count(*) AS n FROM means a JOIN means b ON a.work = b.work AND a.model < b.model GROUP BY ALL)
  SELECT model_a, model_b, coalesce(n, 0) AS n_pairs, CASE WHEN n IS NULL THEN 'unavailable' ELSE 'available' END AS status FROM p LEFT JOIN n USING (model_a, model_b)""")
def hlp10(spark, d):
    """Every two models, also those that share no work."""
    m = metrics(spark, d).where("model is not null").select("model").distinct()
    pairs = m.select(F.col("model").alias("model_a")).join(m.select(F.col("model").alias("model_b")), F.col("model_a") < F.col("model_b"))
    n = differences(spark, d).groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(n, ["model_a", "model_b"], "left").select(
        "model_a", "model_b", F.coalesce("n", F.lit(0)).alias("n_pairs"), F.when(F.col("n").isNull(), "unavailable").otherwise("available").alias("status")
    )


@C.add("agg16_medians", DIFF_SQL + " SELECT model_a, model_b, round(median(difference), 6) AS median FROM diff GROUP BY 1, 2")
def agg16(spark, d):
    return differences(spark, d).groupBy("model_a", "model_b").agg(F.round(F.percentile("difference", 0.5), 6).alias("median"))


@C.add("sta01_paired_models", DIFF_SQL + """ SELECT model_a, model_b, count(*) AS n_pairs, round(avg(difference), 6) AS mean, round(median(difference), 6) AS median,
  round(quantile_cont(difference, 0.025), 6) AS low, round(quantile_cont(difference, 0.975), 6) AS high FROM diff GROUP BY 1, 2""")
def sta01(spark, d):
    return T.paired_summary(differences(spark, d))


RANK_SQL = DIFF_SQL + """, nz AS (SELECT model_a, model_b, work, round(difference, 12) AS r FROM diff WHERE round(difference, 12) <> 0),
  ranked AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(r)) + (count(*) OVER (PARTITION BY model_a, model_b, abs(r)) - 1) / 2 AS rank FROM nz)"""


@C.add("win10_signed_ranks", RANK_SQL + " SELECT model_a, model_b, work, rank FROM ranked")
def win10(spark, d):
    return T.signed_ranks(differences(spark, d)).select("model_a", "model_b", "work", "rank")


@C.add("sta02_wilcoxon", RANK_SQL + """ SELECT model_a, model_b, CAST(count(*) AS BIGINT) AS n_nonzero, sum(CASE WHEN r > 0 THEN rank ELSE 0 END) AS w_plus, sum(CASE WHEN r < 0 THEN rank ELSE 0 END) AS w_minus,
  least(sum(CASE WHEN r > 0 THEN rank ELSE 0 END), sum(CASE WHEN r < 0 THEN rank ELSE 0 END)) AS statistic FROM ranked GROUP BY 1, 2""")
def sta02(spark, d):
    return T.wilcoxon(differences(spark, d)).drop("p_value")


@C.add("sta02_wilcoxon_p")
def sta02p(spark, d):
    """The test's p, adjusted over all pairs."""
    return T.holm(T.wilcoxon(differences(spark, d)), "p_value", "model_a", "model_b")


@C.add("win09_holm", DIFF_SQL + """, p AS (SELECT model_a, model_b, round(1 / (1 + abs(sum(difference))), 6) AS p FROM diff GROUP BY 1, 2),
  s AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, model_a, model_b) + 1) AS step FROM p)
  SELECT model_a, model_b, p, round(least(1.0, max(step) OVER (ORDER BY p, model_a, model_b)), 6) AS holm FROM s""")
def win09(spark, d):
    """Step-down adjustment of one value for each pair of models."""
    p = differences(spark, d).groupBy("model_a", "model_b").agg(F.round(1 / (1 + F.abs(F.sum("difference"))), 6).alias("p"))
    return T.holm(p, "p", "model_a", "model_b").withColumn("holm", F.round("holm", 6))


@C.add("sta04_bootstrap", DIFF_SQL + """, i AS (SELECT *, row_number() OVER (PARTITION BY model_a, model_b ORDER BY work) - 1 AS i, count(*) OVER (PARTITION BY model_a, model_b) AS n FROM diff),
  d AS (SELECT model_a, model_b, n, b, unnest(range(n)) AS draw FROM (SELECT DISTINCT model_a, model_b, n, unnest(range(200)) AS b FROM i)),
  h AS (SELECT model_a, model_b, b, CAST(('0x' || substr(md5('7:' || b || ':' || draw), 1, 8)) AS BIGINT) % n AS i FROM d),
  m AS (SELECT h.model_a, h.model_b, h.b, avg(i.difference) AS mean FROM h JOIN i USING (model_a, model_b, i) GROUP BY ALL)
  SELECT model_a, model_b, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY 1, 2""")
def sta04(spark, d):
    """As many resamples as its SQL draws; ``sta04_bootstrap_whole`` draws the reference's."""
    return T.bootstrap(differences(spark, d), 200)


@C.add("sta04_bootstrap_whole")
def sta04_whole(spark, d):
    """The same interval from 10 000 resamples."""
    return T.bootstrap(differences(spark, d))


@C.add("agg24_estimands", f"""WITH {METRICS_SQL}, w AS (SELECT model, work, avg(nll) AS nll, avg(n_tokens) AS n FROM metrics WHERE model IS NOT NULL AND work IS NOT NULL AND nll IS NOT NULL AND frac = 1.0 GROUP BY ALL),
  p AS (SELECT a.model AS model_a, b.model AS model_b, a.nll - b.nll AS d, a.n AS n FROM w a JOIN w b ON a.work = b.work AND a.model < b.model)
  SELECT model_a, model_b, round(avg(d), 6) AS per_work, round(sum(d * n) / sum(n), 6) AS token_weighted FROM p GROUP BY 1, 2""")
def agg24(spark, d):
    """Two estimands of one difference: each work counts once, or by its tokens."""
    w = metrics(spark, d).where("frac = 1.0 and model is not null and work is not null and nll is not null").groupBy("model", "work").agg(F.avg("nll").alias("nll"), F.avg("n_tokens").alias("n"))
    a, b = w.select(F.col("model").alias("model_a"), "work", F.col("nll").alias("a"), "n"), w.select(F.col("model").alias("model_b"), "work", F.col("nll").alias("b"))
    x = F.col("a") - F.col("b")
    return a.join(b, "work").where("model_a < model_b").groupBy("model_a", "model_b").agg(
        F.round(F.avg(x), 6).alias("per_work"), F.round(F.sum(x * F.col("n")) / F.sum("n"), 6).alias("token_weighted")
    )


@C.add("agg27_win_tie_loss", DIFF_SQL + " SELECT model_a, model_b, CAST(sum(CASE WHEN difference < 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN difference = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ties, CAST(sum(CASE WHEN difference > 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses FROM diff GROUP BY 1, 2")
def agg27(spark, d):
    return differences(spark, d).groupBy("model_a", "model_b").agg(
        F.count_if(F.col("difference") < 0).alias("wins"), F.count_if(F.col("difference") == 0).alias("ties"), F.count_if(F.col("difference") > 0).alias("losses")
    )


SERIES_SQL = f"""WITH {METRICS_SQL}, x AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY work) AS t, nll FROM (SELECT model, work, avg(nll) AS nll FROM metrics WHERE model IS NOT NULL AND work IS NOT NULL AND nll IS NOT NULL AND frac = 1.0 GROUP BY ALL))"""


def series(spark, d):
    """The works' means of each model as a series."""
    return work_means(spark, d).withColumn("t", F.row_number().over(Window.partitionBy("model").orderBy("work"))).select("model", "t", "nll")


@C.add("agg28_lag_one", SERIES_SQL + """, c AS (SELECT model, t, nll - avg(nll) OVER (PARTITION BY model) AS c FROM x), l AS (SELECT *, lag(c) OVER (PARTITION BY model ORDER BY t) AS b FROM c)
  SELECT model, count(*) AS n, round(CASE WHEN count(*) >= 3 AND sum(c * c) > 0 THEN sum(c * b) / sum(c * c) END, 6) AS lag_one FROM l GROUP BY 1""")
def agg28(spark, d):
    return T.lag_one(series(spark, d), "model", "t", "nll")


DRIFT_SQL = SERIES_SQL + """, p AS (SELECT *, count(*) OVER (PARTITION BY model) AS n FROM x),
  h AS (SELECT model, count(*) AS n, avg(CASE WHEN t <= greatest(1, n // 2) THEN nll END) AS early, avg(CASE WHEN t > greatest(1, n // 2) THEN nll END) AS late FROM p GROUP BY 1),
  chains AS (SELECT model, n, round(early, 6) AS early, round(late, 6) AS late, round(late - early, 6) AS drift, abs(late - early) <= 0.01 * greatest(abs(early), abs(late), 1.0) AS stable FROM h)"""


@C.add("agg29_drift", DRIFT_SQL + " SELECT * FROM chains")
def agg29(spark, d):
    return T.drift(series(spark, d), "model", "t", "nll")


@C.add("agg30_verdict", DRIFT_SQL + """, k AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY work) AS t, k, count(*) OVER (PARTITION BY model) AS n FROM (SELECT model, work, count(*) AS k FROM metrics WHERE model IS NOT NULL AND work IS NOT NULL AND nll IS NOT NULL AND frac = 1.0 GROUP BY ALL)),
  la AS (SELECT model, round(avg(CASE WHEN t > greatest(1, n // 2) THEN k END), 6) AS late_active FROM k GROUP BY 1)
  SELECT count(*) AS n_chains, round(max(late) - min(late), 6) AS spread, CASE WHEN count(*) = 0 THEN 'no_evidence' WHEN min(n) < 50 THEN 'chains_too_short' WHEN NOT bool_and(stable) THEN 'drift_detected'
  WHEN count(*) > 1 AND NOT (max(late) - min(late) <= 0.02 * max(abs(late)) AND max(late_active) - min(late_active) <= 1) THEN 'chains_disagree' WHEN count(*) < 2 THEN 'single_chain_no_cross_chain_evidence' ELSE 'stable_within_the_observed_window' END AS verdict,
  round(max(late_active) - min(late_active), 6) AS active_spread FROM chains JOIN la USING (model)""")
def agg30(spark, d):
    """The works' scores as chains; the runs behind each work stand for active states."""
    k = metrics(spark, d).where("model is not null and work is not null and nll is not null and frac = 1.0").groupBy("model", "work").agg(F.count(F.lit(1)).alias("k"))
    numbered = k.withColumn("t", F.row_number().over(Window.partitionBy("model").orderBy("work")))
    active = T.drift(numbered, "model", "t", "k").select("model", F.col("late").alias("late_active"))
    return T.chain_verdict(T.drift(series(spark, d), "model", "t", "nll").join(active, "model"))


@C.add("win14_best_so_far", SERIES_SQL + """, b AS (SELECT *, min(nll) OVER (PARTITION BY model ORDER BY t) AS best, min(nll) OVER (PARTITION BY model ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
  i AS (SELECT *, coalesce(nll < before, true) AS improved FROM b)
  SELECT model, CAST(t AS INTEGER) AS t, round(best, 6) AS best, improved, CAST(t - max(CASE WHEN improved THEN t END) OVER (PARTITION BY model ORDER BY t) AS INTEGER) AS patience FROM i""")
def win14(spark, d):
    return best_so_far(series(spark, d), "model", "t", "nll").select("model", "t", F.round("best", 6).alias("best"), "improved", "patience")


@C.add("win11_quartiles", SERIES_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY nll, t) AS p, count(*) OVER (PARTITION BY model) AS n FROM x)
  SELECT model, quartile, count(*) AS n, round(avg(nll), 6) AS mean FROM (SELECT *, CASE WHEN p <= n // 4 THEN 1 WHEN p <= n // 2 THEN 2 WHEN p <= 3 * n // 4 THEN 3 ELSE 4 END AS quartile FROM r) GROUP BY 1, 2""")
def win11(spark, d):
    """Quarters of equal count, cut at n/4, n/2 and 3n/4."""
    by = Window.partitionBy("model")
    p, n = F.row_number().over(by.orderBy("nll", "t")), F.count(F.lit(1)).over(by)
    rows = series(spark, d).withColumn("p", p).withColumn("n", n)
    q = F.when(F.col("p") <= F.floor(F.col("n") / 4), 1).when(F.col("p") <= F.floor(F.col("n") / 2), 2).when(F.col("p") <= F.floor(3 * F.col("n") / 4), 3).otherwise(4)
    return rows.withColumn("quartile", q).groupBy("model", "quartile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("nll"), 6).alias("mean"))


@C.add("win12_terciles", f"""WITH {RECORDS_SQL}, s AS (SELECT list_sort(list(n_tokens)) AS a, count(*) AS n FROM records WHERE n_tokens IS NOT NULL)
  SELECT a[1 + least(n - 1, greatest(0, n // 3 - 1))] AS short_cut, a[1 + least(n - 1, greatest(0, 2 * n // 3 - 1))] AS medium_cut FROM s""")
def win12(spark, d):
    """Cut values at a third and two thirds, from counts of each value."""
    n = records(spark, d).where("n_tokens is not null")
    return order_statistics(n, "n_tokens", {"short_cut": lambda m: F.greatest(F.floor(m / 3) - 1, F.lit(0)), "medium_cut": lambda m: F.greatest(F.floor(2 * m / 3) - 1, F.lit(0))})


@C.add("agg17_percentiles", RUNS_SQL + " SELECT model, round(quantile_cont(test_nll, 0.025), 6) AS low, round(quantile_cont(test_nll, 0.5), 6) AS mid, round(quantile_cont(test_nll, 0.975), 6) AS high FROM runs GROUP BY 1")
def agg17(spark, d):
    return runs(spark, d).groupBy("model").agg(*[F.round(F.percentile("test_nll", p), 6).alias(n) for p, n in ((0.025, "low"), (0.5, "mid"), (0.975, "high"))])


@C.add("agg18_max", RUNS_SQL + " SELECT model, max(n_tokens) AS n_tokens, round(max(test_nll), 6) AS test_nll FROM runs GROUP BY 1")
def agg18(spark, d):
    return runs(spark, d).groupBy("model").agg(F.max("n_tokens").alias("n_tokens"), F.round(F.max("test_nll"), 6).alias("test_nll"))


@C.add("agg19_argmin", RUNS_SQL + """ SELECT model, frac, data_seed, model_seed, split_seed FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(test_nll, 9), frac, data_seed, model_seed, split_seed) AS rn FROM runs WHERE test_nll IS NOT NULL) WHERE rn = 1""")
def agg19(spark, d):
    """Each model's best run; the first of equals."""
    keys = ["frac", "data_seed", "model_seed", "split_seed"]
    best = runs(spark, d).where("test_nll is not null").groupBy("model").agg(F.min(F.struct(F.round("test_nll", 9).alias("s"), *keys)).alias("b"))
    return best.select("model", *[f"b.{k}" for k in keys])


@C.add("agg33_works_of_models", M + "SELECT model, array_to_string(list_sort(list(DISTINCT work)), '|') AS works, count(DISTINCT work) AS n_works FROM metrics WHERE work IS NOT NULL AND model IS NOT NULL AND frac = 1.0 GROUP BY 1")
def agg33(spark, d):
    return metrics(spark, d).where("work is not null and model is not null and frac = 1.0").groupBy("model").agg(
        F.array_join(F.sort_array(F.collect_set("work")), "|").alias("works"), F.countDistinct("work").alias("n_works")
    )


@C.add("agg38_pareto_inputs", RUNS_SQL + " SELECT model, round(avg(test_nll), 6) AS nll, round(avg(n_tokens), 6) AS tokens FROM runs WHERE frac = 1.0 AND test_nll IS NOT NULL GROUP BY 1")
def agg38(spark, d):
    return runs(spark, d).where("frac = 1.0 and test_nll is not null").groupBy("model").agg(F.round(F.avg("test_nll"), 6).alias("nll"), F.round(F.avg("n_tokens"), 6).alias("tokens"))


FRONT_SQL = RUNS_SQL + """, m AS (SELECT model, frac, round(avg(test_nll), 6) AS nll, round(avg(n_tokens), 6) AS tokens, round(stddev_pop(test_nll), 6) AS spread FROM runs GROUP BY 1, 2)"""


def model_points(spark, d):
    return runs(spark, d).groupBy("model", "frac").agg(
        F.round(F.avg("test_nll"), 6).alias("nll"), F.round(F.avg("n_tokens"), 6).alias("tokens"), F.round(F.stddev_pop("test_nll"), 6).alias("spread")
    )


@C.add("jon08_pareto", FRONT_SQL + """ SELECT model, frac, nll, tokens, spread FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.nll <= a.nll AND b.frac <= a.frac AND b.spread <= a.spread AND (b.nll < a.nll OR b.frac < a.frac OR b.spread < a.spread))""")
def jon08(spark, d):
    return T.pareto_front(model_points(spark, d), ["nll", "frac", "spread"])


@C.add("sta08_front_summary", FRONT_SQL + """ SELECT model, count(*) AS n_points, CAST(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM m b WHERE b.nll <= a.nll AND b.frac <= a.frac AND (b.nll < a.nll OR b.frac < a.frac)) THEN 1 ELSE 0 END) AS BIGINT) AS n_on_front FROM m a GROUP BY 1""")
def sta08(spark, d):
    points = model_points(spark, d)
    front = T.pareto_front(points, ["nll", "frac"]).groupBy("model").agg(F.count(F.lit(1)).alias("k"))
    return points.groupBy("model").agg(F.count(F.lit(1)).alias("n_points")).join(front, "model", "left").select("model", "n_points", F.coalesce("k", F.lit(0)).alias("n_on_front"))


@C.add("jon08_two_axis_front", """WITH s AS (SELECT c_custkey AS k, c_acctbal AS x, c_nationkey AS y FROM customer) SELECT k, x, y FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y))""")
def jon08b(spark, d):
    """A front over many rows, without comparing all of them."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    return T.two_axis_front(rows, "k", "x", "y")


@C.add("agg37_grid_audit", RUNS_SQL + """, s AS (SELECT model, data_seed, arg_min(frac, struct_pack(a := round(test_nll, 9), b := frac)) AS selected FROM runs WHERE test_nll IS NOT NULL GROUP BY ALL), g AS (SELECT max(frac) AS top FROM runs)
  SELECT model, count(*) AS n_selections, CAST(sum(CASE WHEN selected = top THEN 1 ELSE 0 END) AS BIGINT) AS n_at_top, CASE WHEN sum(CASE WHEN selected = top THEN 1 ELSE 0 END) * 2 >= count(*) THEN 'grid_too_small' ELSE 'grid_informative' END AS verdict FROM s CROSS JOIN g GROUP BY 1""")
def agg37(spark, d):
    """Selections that keep touching the top of the grid mean a short grid."""
    r = runs(spark, d).where("test_nll is not null")
    top = runs(spark, d).agg(F.max("frac").alias("top"))
    s = r.groupBy("model", "data_seed").agg(F.min_by("frac", F.struct(F.round("test_nll", 9), "frac")).alias("selected")).join(F.broadcast(top))
    at = F.count_if(F.col("selected") == F.col("top"))
    return s.groupBy("model").agg(F.count(F.lit(1)).alias("n_selections"), at.alias("n_at_top"), F.when(at * 2 >= F.count(F.lit(1)), "grid_too_small").otherwise("grid_informative").alias("verdict"))


COST_SQL = RUNS_SQL + """, c AS (SELECT model, CASE WHEN model LIKE '%transformer%' THEN 'gpu' ELSE 'cpu' END AS device, avg(n_tokens / 1000.0) AS fit_s, avg(n_rows / 10.0) AS eval_s FROM runs WHERE frac = 1.0 GROUP BY ALL),
  t AS (SELECT * FROM (VALUES ('cpu', 1.0), ('gpu', 2.0)) t(device, rate)), s AS (SELECT * FROM (VALUES ('fit', 0), ('reuse', 10)) s(scenario, repetitions))"""


def costs(spark, d):
    device = F.when(F.col("model").contains("transformer"), "gpu").otherwise("cpu")
    return runs(spark, d).where("frac = 1.0").groupBy("model", device.alias("device")).agg(F.avg(F.col("n_tokens") / 1000.0).alias("fit_s"), F.avg(F.col("n_rows") / 10.0).alias("eval_s"))


def tariffs(spark):
    return spark.createDataFrame([("cpu", 1.0), ("gpu", 2.0)], "device string, rate double"), spark.createDataFrame([("fit", 0), ("reuse", 10)], "scenario string, repetitions int")


@C.add("agg39_cost_scenarios", COST_SQL + " SELECT model, scenario, round((fit_s + repetitions * eval_s) / 3600 * rate, 9) AS cost FROM c JOIN t USING (device) CROSS JOIN s")
def agg39(spark, d):
    """Cost of fitting and of evaluating again and again, for every scenario."""
    rate, scenario = tariffs(spark)
    cost = (F.col("fit_s") + F.col("repetitions") * F.col("eval_s")) / 3600 * F.col("rate")
    return costs(spark, d).join(F.broadcast(rate), "device").crossJoin(F.broadcast(scenario)).select("model", "scenario", F.round(cost, 9).alias("cost"))


@C.add("sta10_break_even", COST_SQL + """, x AS (SELECT model, fit_s * rate AS fit, eval_s * rate AS ev FROM c JOIN t USING (device))
  SELECT a.model AS model_a, b.model AS model_b, round((b.fit - a.fit) / nullif(a.ev - b.ev, 0), 6) AS repetitions FROM x a JOIN x b ON a.model < b.model""")
def sta10(spark, d):
    """How many evaluations make two models cost the same."""
    rate, _ = tariffs(spark)
    x = costs(spark, d).join(F.broadcast(rate), "device").select("model", (F.col("fit_s") * F.col("rate")).alias("fit"), (F.col("eval_s") * F.col("rate")).alias("ev"))
    a, b = x.toDF("model_a", "fa", "ea"), x.toDF("model_b", "fb", "eb")
    return a.join(b, F.col("model_a") < F.col("model_b")).select("model_a", "model_b", F.round(F.try_divide(F.col("fb") - F.col("fa"), F.col("ea") - F.col("eb")), 6).alias("repetitions"))


@C.add("agg44_cost_by_model", COST_SQL + " SELECT model, device, round(fit_s, 6) AS fit_s FROM c")
def agg44(spark, d):
    return costs(spark, d).select("model", "device", F.round("fit_s", 6).alias("fit_s"))


@C.add("jon06_reconcile", RUNS_SQL + """, raw AS (SELECT model, frac, avg(test_nll) AS nll, count(test_nll) AS n FROM runs GROUP BY 1, 2),
  pub AS (SELECT model, frac, round(nll, 3) AS nll, n FROM raw WHERE frac >= 0.5 UNION ALL SELECT 'absent', 1.0, 2.0, 1)
  SELECT coalesce(r.model, p.model) AS model, coalesce(r.frac, p.frac) AS frac, CASE WHEN r.model IS NULL THEN 'no_raw_rows' WHEN p.model IS NULL THEN 'missing_summary_row'
    WHEN abs(r.nll - p.nll) > 1e-4 THEN 'mean_test_nll' WHEN r.n <> p.n THEN 'runs' ELSE 'ok' END AS reason FROM raw r FULL JOIN pub p ON r.model = p.model AND r.frac = p.frac""")
def jon06(spark, d):
    """A published summary held against the raw rows."""
    raw = runs(spark, d).groupBy("model", "frac").agg(F.avg("test_nll").alias("nll"), F.count("test_nll").alias("n"))
    absent = spark.createDataFrame([("absent", 1.0, 2.0, 1)], "model string, frac double, nll double, n bigint")
    published = raw.where("frac >= 0.5").withColumn("nll", F.round("nll", 3)).unionByName(absent)
    return reconcile(raw, published, ["model", "frac"], "nll", "n", 1e-4)


@C.add("jon15_run_status", RUNS_SQL + """, g AS (SELECT m.model, f.frac, s.data_seed FROM (SELECT DISTINCT model FROM runs) m CROSS JOIN (SELECT DISTINCT frac FROM runs) f CROSS JOIN (SELECT DISTINCT data_seed FROM runs) s)
  SELECT g.model, g.frac, g.data_seed, CASE WHEN count(r.model) > 0 THEN 'completed' ELSE 'missing' END AS status FROM g LEFT JOIN runs r ON r.model = g.model AND r.frac = g.frac AND r.data_seed = g.data_seed GROUP BY ALL""")
def jon15(spark, d):
    """The planned grid with what is done and what is missing."""
    r = runs(spark, d)
    grid = r.select("model").distinct().crossJoin(r.select("frac").distinct()).crossJoin(r.select("data_seed").distinct())  # a plan: models x fractions x seeds
    done = r.select("model", "frac", "data_seed").distinct().withColumn("done", F.lit(True))
    return grid.join(done, ["model", "frac", "data_seed"], "left").select("model", "frac", "data_seed", F.when(F.col("done"), "completed").otherwise("missing").alias("status"))


@C.add("dq07_denominators", f"""WITH {METRICS_SQL} SELECT model, count(*) AS n_rows, CAST(sum(CASE WHEN nll IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_score, CAST(sum(CASE WHEN work IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_work,
  count(DISTINCT CASE WHEN nll IS NOT NULL AND work IS NOT NULL THEN piece_id END) AS n_files, count(DISTINCT CASE WHEN nll IS NOT NULL THEN work END) AS n_works,
  count(DISTINCT CASE WHEN nll IS NOT NULL AND work IS NOT NULL THEN piece_id END) - count(DISTINCT CASE WHEN nll IS NOT NULL THEN work END) AS absorbed FROM metrics WHERE model IS NOT NULL GROUP BY 1""")
def dq07(spark, d):
    """Scored files against works, with why rows were left out."""
    return denominators(metrics(spark, d).where("model is not null"))


@C.add("jon04_unscored", f"""WITH {METRICS_SQL}, {RECORDS_SQL} SELECT piece_id FROM records WHERE split = 'test' AND piece_id NOT IN (SELECT piece_id FROM metrics WHERE nll IS NOT NULL AND piece_id IS NOT NULL)""")
def jon04(spark, d):
    """Test pieces that no model scored."""
    scored = metrics(spark, d).where("nll is not null").select("piece_id")
    return records(spark, d).where("split = 'test'").select("piece_id").join(scored, "piece_id", "left_anti")


@C.add("prj12_finite", "SELECT CAST(sum(CASE WHEN nll_per_token IS NOT NULL AND isfinite(nll_per_token) THEN 1 ELSE 0 END) AS BIGINT) AS finite, CAST(sum(CASE WHEN isnan(nll_per_token) THEN 1 ELSE 0 END) AS BIGINT) AS nan, CAST(sum(CASE WHEN nll_per_token IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM piece_metrics")
def prj12(spark, d):
    rows = table(spark, d, "piece_metrics")
    return rows.agg(F.count(T.finite(F.col("nll_per_token"))).alias("finite"), F.count_if(F.isnan("nll_per_token")).alias("nan"), F.count_if(F.col("nll_per_token").isNull()).alias("missing"))


@C.add("prj13_full_fraction", M + "SELECT count(*) AS n FROM metrics WHERE abs(frac - 1) <= 1e-9")
def prj13(spark, d):
    return metrics(spark, d).where(F.abs(F.col("frac") - 1) <= 1e-9).agg(F.count(F.lit(1)).alias("n"))


@C.add("hlp11_model_seed", "SELECT model_seed = 'deterministic' AS deterministic, try_cast(model_seed AS INTEGER) AS seed, count(*) AS n FROM piece_metrics GROUP BY ALL")
def hlp11(spark, d):
    """A seed that is a number, or a word for none."""
    rows = table(spark, d, "piece_metrics")
    return rows.groupBy((F.col("model_seed") == "deterministic").alias("deterministic"), F.col("model_seed").try_cast("int").alias("seed")).agg(F.count(F.lit(1)).alias("n"))


@C.add("fig02_unpivot", RUNS_SQL + """, m AS (SELECT model, round(avg(test_nll), 6) AS nll, round(avg(n_tokens), 6) AS tokens FROM runs GROUP BY 1) SELECT model, 'nll' AS measure, nll AS value FROM m UNION ALL SELECT model, 'tokens', tokens FROM m""")
def fig02(spark, d):
    wide = runs(spark, d).groupBy("model").agg(F.round(F.avg("test_nll"), 6).alias("nll"), F.round(F.avg("n_tokens"), 6).alias("tokens"))
    return wide.unpivot("model", ["nll", "tokens"], "measure", "value")


@C.add("cmp02_pivot", RUNS_SQL + " SELECT frac, " + ", ".join(f"round(avg(CASE WHEN model = '{m}' THEN test_nll END), 6) AS {m}" for m in ("finite_hmm", "hdp_hmm", "transformer", "vomm")) + " FROM runs GROUP BY 1")
def cmp02(spark, d):
    """One column for each model."""
    out = runs(spark, d).groupBy("frac").pivot("model", ["finite_hmm", "hdp_hmm", "transformer", "vomm"]).agg(F.avg("test_nll"))
    return out.select("frac", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@C.add("fig05_change", RUNS_SQL + """, c AS (SELECT model, frac, avg(test_nll) AS nll FROM runs GROUP BY 1, 2) SELECT model, frac, round(100 * (nll / first_value(nll) OVER (PARTITION BY model ORDER BY frac) - 1), 6) AS change FROM c""")
def fig05(spark, d):
    """Change in percent against the smallest fraction."""
    c = runs(spark, d).groupBy("model", "frac").agg(F.avg("test_nll").alias("nll"))
    first = F.first("nll").over(Window.partitionBy("model").orderBy("frac"))
    return c.select("model", "frac", F.round(100 * (F.col("nll") / first - 1), 6).alias("change"))
