"""Queries on runs and settings: costs, resources, collected artifacts, sampling, scalar functions of models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.functions import scalars as N
from scorelake.operators import audits as A
from scorelake.operators import hidden_markov as HM
from scorelake.operators import harmony as H
from scorelake.operators import quality as Q
from scorelake.operators import sequences as S
from scorelake.operators import statistics as T
from scorelake.plans.common import Catalogue
from scorelake.plans.metrics import FRONT_SQL, RUNS_SQL, model_points, runs
from scorelake.plans.models import BOUNDARY_SQL, boundaries, pitch_sequences
from scorelake.session import scratch_folder
from scorelake.sources import catalogs, sinks
from scorelake.sources.relations import EVENTS_SQL, METRICS_SQL, PIECES_SQL, TOKENS_SQL, events, metrics, pieces, tokens
from scorelake.sources.tables import table
from scorelake.streaming import sequences as ST

C = Catalogue()
U_SQL = "((('0x' || substr(md5({key}), 1, 8))::UBIGINT + 0.5) / 4294967296.0)"


@C.add("mth04_dirichlet_density", f"""WITH {EVENTS_SQL}, c AS (SELECT piece_id, pc % 12 AS k, count(*) AS n FROM ev WHERE pc IS NOT NULL GROUP BY 1, 2), t AS (SELECT piece_id, sum(n) AS total FROM c GROUP BY 1),
  x AS (SELECT t.piece_id, p.k, (coalesce(n, 0) + 1.0) / (total + 12.0) AS s FROM t CROSS JOIN range(12) p(k) LEFT JOIN c ON c.piece_id = t.piece_id AND c.k = p.k)
  SELECT piece_id, round(lgamma(17.5) - sum(lgamma(1 + k / 12.0)) + sum(k / 12.0 * ln(s)), 6) AS density FROM x GROUP BY 1""")
def mth04(spark, d):
    """Log density of each piece's smoothed pitch-class shares under a Dirichlet law."""
    counts = [F.count_if(F.pmod("pc", F.lit(12)) == i) for i in range(12)]
    rows = events(spark, d).where("pc is not null").groupBy("piece_id").agg(F.count(F.lit(1)).alias("total"), F.array(*counts).alias("n"))
    shares = F.transform("n", lambda x: (x + 1.0) / (F.col("total") + 12.0))
    return rows.withColumn("s", shares).select("piece_id", F.round(N.dirichlet_log_density(F.col("s"), [1 + i / 12.0 for i in range(12)]), 6).alias("density"))


@C.add("mth13_parameter_counts", """WITH v AS (SELECT count(*) AS v FROM token_vocabulary), k AS (SELECT unnest([12, 24, 48]) AS states)
  SELECT CAST(states AS INTEGER) AS states, (states - 1) + states * (states - 1) + states * (v - 1) AS hmm, v * 64 + 512 * 64 + 2 * (4 * 64 * 64 + 2 * 64 * 128 + 8 * 64 + 128 + v) AS transformer FROM v, k""")
def mth13(spark, d):
    """Parameters of models over the vocabulary there is."""
    v = table(spark, d, "token_vocabulary").agg(F.count(F.lit(1)).alias("v"))
    return v.withColumn("states", F.explode(F.array(*[F.lit(k) for k in (12, 24, 48)]))).select(
        "states", N.hmm_parameters(F.col("states"), F.col("v")).alias("hmm"), N.transformer_parameters(F.col("v"), 64, 2, 128, 512).alias("transformer")
    )


@C.add("mth16_position_buckets", f"WITH {TOKENS_SQL} SELECT CAST(CASE WHEN t < 16 THEN t ELSE least(16 + floor(ln(t / 16.0) * (16 / ln(8.0))), 31) END AS INTEGER) AS bucket, count(*) AS n FROM tok GROUP BY 1")
def mth16(spark, d):
    """Distances to the start of every token's piece, bucketed."""
    return tokens(spark, d).groupBy(N.relative_bucket(F.col("t")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@C.add("stx08_interval_labels", f"""WITH {EVENTS_SQL}, i AS (SELECT midi - lag(midi) OVER (PARTITION BY piece_id ORDER BY t) AS i FROM ev)
  SELECT printf('INT_%+d', CAST(greatest(-12, least(12, i)) AS INTEGER)) AS label, count(*) AS n FROM i WHERE i IS NOT NULL GROUP BY 1""")
def stx08(spark, d):
    step = F.col("midi") - F.lag("midi").over(Window.partitionBy("piece_id").orderBy("t"))
    rows = events(spark, d).select(step.alias("i")).where("i is not null")
    return rows.groupBy(N.interval_label(F.greatest(F.lit(-12), F.least(F.lit(12), F.col("i")))).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@C.add("stx08_duration_labels", f"WITH {EVENTS_SQL} SELECT ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][pc % 12 + 1] || '|dur=' || printf('%g', duration) AS label, count(*) AS n FROM ev WHERE pc IS NOT NULL AND duration IS NOT NULL GROUP BY 1")
def stx08b(spark, d):
    """Labels of pitch class and duration as a vocabulary writes them."""
    name = F.get(F.array(*[F.lit(x) for x in H.NAMES]), F.pmod("pc", F.lit(12)).cast("int"))
    rows = events(spark, d).where("pc is not null and duration is not null")
    return rows.groupBy(F.concat(name, F.lit("|dur="), N.short_number(F.col("duration"))).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@C.add("srt12_length_buckets", f"""WITH {PIECES_SQL}, x AS (SELECT piece_id, CAST(len(tokens) AS BIGINT) AS n, CAST(ceil(log2(len(tokens))) AS INTEGER) AS class, md5(piece_id) AS h FROM pieces WHERE len(tokens) > 0),
  b AS (SELECT class, substr(h, 1, 1) AS range, n, (row_number() OVER (PARTITION BY class, substr(h, 1, 1) ORDER BY h, piece_id) - 1) // greatest(1, 100000 // CAST(2 ** class AS BIGINT)) AS batch FROM x)
  SELECT class, range, batch, count(*) AS n_pieces, CAST(count(*) * max(n) AS BIGINT) AS cells FROM b GROUP BY 1, 2, 3""")
def srt12(spark, d):
    """Pieces of like length in batches of at most 100 000 padded cells."""
    return S.length_batches(pieces(spark, d).select("piece_id", F.size("tokens").alias("n")), "piece_id", "n", 100_000).groupBy("class", "range", "batch").agg(
        F.count(F.lit(1)).alias("n_pieces"), (F.count(F.lit(1)) * F.max("n")).cast("bigint").alias("cells")
    )


GUMBEL_SQL = f"""WITH {TOKENS_SQL}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY 1), r AS (SELECT token, ln(n) / 0.8 AS logit, row_number() OVER (ORDER BY n DESC, token) AS place FROM c),
  g AS (SELECT p.piece_id, r.token, logit - ln(-ln({U_SQL.format(key="'5:' || p.piece_id || ':' || r.token")})) AS score FROM (SELECT piece_id FROM pieces) p CROSS JOIN r WHERE place <= 10)"""


@C.add("srt13_gumbel_top_k", GUMBEL_SQL + " SELECT piece_id, arg_max(token, struct_pack(s := round(score, 9), t := -token)) AS token FROM g GROUP BY 1")
def srt13(spark, d):
    """A token for each piece from the ten commonest at temperature 0.8, by the Gumbel maximum."""
    counts = tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))  # a row a token of the vocabulary
    return S.gumbel_draws(pieces(spark, d).select("piece_id"), "piece_id", counts, "token", "n", 5, 10, 0.8)


@C.add("hdp02_initial_states", f"""WITH {EVENTS_SQL}, v AS (SELECT pc, dense_rank() OVER (ORDER BY pc) - 1 AS i FROM (SELECT DISTINCT pc FROM ev WHERE pc IS NOT NULL)),
  x AS (SELECT CASE WHEN {U_SQL.format(key="'3:' || piece_id || ':' || t")} < 0.1 THEN CAST(floor({U_SQL.format(key="'4:' || piece_id || ':' || t")} * 8) AS INTEGER) ELSE CAST(i % 8 AS INTEGER) END AS state FROM ev JOIN v USING (pc))
  SELECT state, count(*) AS n FROM x GROUP BY 1""")
def hdp02(spark, d):
    """States a sampler starts from: symbols in order round the active states, a tenth of the events anywhere."""
    return HM.initial_states(events(spark, d).where("pc is not null"), "pc", 8, 24, 12, 3, "piece_id", "t").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@C.add("hlp07_stick_weights", f"""WITH s AS (SELECT DISTINCT split_seed AS seed FROM piece_metrics WHERE split_seed IS NOT NULL), v AS (SELECT seed, CAST(i AS INTEGER) AS i, 1 - pow(1 - {U_SQL.format(key="'6:' || seed || ':' || i")}, 1 / 3.0) AS v FROM s CROSS JOIN range(24) k(i)),
  b AS (SELECT seed, i, v, sum(ln(1 - v)) OVER (PARTITION BY seed ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v) SELECT seed, i, round(v * exp(coalesce(b, 0)), 6) AS weight FROM b""")
def hlp07(spark, d):
    """Truncated stick-breaking weights, the breaks drawn from Beta(1, 3) by its inverse, for every seed of the runs."""
    seeds = table(spark, d, "piece_metrics").where("split_seed is not null").select(F.col("split_seed").alias("seed")).distinct()
    rows = seeds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(23))))
    v = 1 - F.pow(1 - N.uniform(6, F.col("seed").cast("string"), F.col("i").cast("string")), F.lit(1 / 3.0))
    return S.stick_breaking(rows.withColumn("v", v), "seed", "i", "v").select("seed", "i", F.round("weight", 6).alias("weight"))


@C.add("hlp09_front_axes", FRONT_SQL + """, a AS (SELECT model, frac, CASE WHEN frac < 0.3 THEN NULL ELSE nll END AS nll, tokens FROM m)
  SELECT model, frac, nll, tokens FROM a x WHERE nll IS NULL OR NOT EXISTS (SELECT 1 FROM a y WHERE y.nll <= x.nll AND y.tokens <= x.tokens AND (y.nll < x.nll OR y.tokens < x.tokens))""")
def hlp09(spark, d):
    """The front of points some of whose axes are not finite; such axes are null in the result."""
    points = model_points(spark, d).withColumn("nll", F.when(F.col("frac") < 0.3, float("nan")).otherwise(F.col("nll")))
    return T.pareto_front(points, ["nll", "tokens"]).select("model", "frac", T.finite(F.col("nll")).alias("nll"), "tokens")


@C.add("hlp13_label_checks", f"""WITH {EVENTS_SQL}, {PIECES_SQL}, e AS (SELECT piece_id, count(*) AS n, count(label) AS k FROM ev GROUP BY 1)
  SELECT piece_id, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n <> len(tokens) THEN 'unequal' WHEN k < n THEN 'null_label' ELSE 'ok' END AS status FROM pieces LEFT JOIN e USING (piece_id)""")
def hlp13(spark, d):
    """Can a piece's two labellings be compared: not empty, of one length, no label missing."""
    e = events(spark, d).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("k"))
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "empty").when(F.col("n") != F.size("tokens"), "unequal").when(F.col("k") < F.col("n"), "null_label").otherwise("ok")
    return pieces(spark, d).select("piece_id", "tokens").join(e, "piece_id", "left").select("piece_id", status.alias("status"))


#: The tables hold no timings; these columns of the runs stand for seconds, some of them missing.
TIMED_SQL = RUNS_SQL + """, timed AS (SELECT model, frac, data_seed, model_seed, split_seed, n_tokens,
    CASE WHEN model_seed <> 'deterministic' THEN test_nll * 100 END AS selection, CASE WHEN data_seed % 2 = 0 THEN n_tokens / 100.0 END AS selected_fit,
    CASE WHEN frac > 0.5 THEN n_rows / 10.0 END AS selected_validation, CASE WHEN n_tokens > 2000 THEN n_tokens / 1000.0 END AS evaluation, CASE WHEN frac > 0.2 THEN n_rows * 1.0 END AS legacy FROM runs),
  costs AS (SELECT *, CASE WHEN selection IS NOT NULL THEN CASE WHEN selected_fit IS NOT NULL THEN 'separated' ELSE 'partially_separated' END
      WHEN selected_fit IS NOT NULL OR selected_validation IS NOT NULL THEN 'partially_separated' WHEN legacy IS NOT NULL THEN 'unseparated_legacy_total' ELSE 'unmeasured' END AS cost_status,
    coalesce(evaluation, 0) + CASE WHEN selection IS NOT NULL THEN selection WHEN selected_fit IS NOT NULL OR selected_validation IS NOT NULL THEN coalesce(selected_fit, 0) + coalesce(selected_validation, 0) ELSE coalesce(legacy, 0) END AS total FROM timed)"""


def timed(spark, d):
    """Runs with columns that stand for seconds."""
    some = lambda on, x: F.when(on, x.cast("double"))
    return runs(spark, d).select(
        "model", "frac", "data_seed", "model_seed", "split_seed", "n_tokens", some(F.col("model_seed") != "deterministic", F.col("test_nll") * 100).alias("selection"),
        some(F.col("data_seed") % 2 == 0, F.col("n_tokens") / 100.0).alias("selected_fit"), some(F.col("frac") > 0.5, F.col("n_rows") / 10.0).alias("selected_validation"),
        some(F.col("n_tokens") > 2000, F.col("n_tokens") / 1000.0).alias("evaluation"), some(F.col("frac") > 0.2, F.col("n_rows")).alias("legacy"),
    )


@C.add("prj20_cost_status", TIMED_SQL + " SELECT cost_status, count(*) AS n, round(sum(total), 6) AS total FROM costs GROUP BY 1")
def prj20(spark, d):
    """Four states of a measured cost, by which of its parts were measured, and the total they allow."""
    return Q.protocol_costs(timed(spark, d)).groupBy("cost_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 6).alias("total"))


@C.add("prj19_cost_rows", TIMED_SQL + """ SELECT model, frac, data_seed, model_seed, split_seed, round(total, 6) AS total, cost_status, 'superseded_by_scoped_resource_fields' AS peak_memory_status,
  'not_measured_reliably' AS energy_status, 'separate_units_not_collapsed' AS cost_scope FROM costs""")
def prj19(spark, d):
    """A row a run: its costs, and what was not measured said so."""
    said = {"peak_memory_status": "superseded_by_scoped_resource_fields", "energy_status": "not_measured_reliably", "cost_scope": "separate_units_not_collapsed"}
    return Q.protocol_costs(timed(spark, d)).select(
        "model", "frac", "data_seed", "model_seed", "split_seed", F.round("total", 6).alias("total"), "cost_status", *[F.lit(v).alias(k) for k, v in said.items()]
    )


@C.add("prj21_resource_fields", TIMED_SQL + """ SELECT model, frac, data_seed, model_seed, split_seed, floor(round(selection * 1000)) AS selection_peak_process_rss_bytes,
  CASE WHEN selection IS NULL THEN 'unavailable' ELSE 'measured' END AS selection_resource_status, floor(round(evaluation * 1000)) AS evaluation_peak_process_rss_bytes,
  CASE WHEN evaluation IS NULL THEN 'unavailable' ELSE 'measured' END AS evaluation_resource_status, 'not_measured_separately' AS selected_fit_resource_status, 0.5 AS resource_sample_interval_s, frac = 1.0 AS resource_cost_usable FROM timed""")
def prj21(spark, d):
    """The observations of selection and evaluation side by side in one row."""
    seen = lambda c, step: F.struct(
        F.floor(F.round(F.col(c) * 1000)).cast("bigint").alias("peak_process_rss_bytes"), F.lit(None).cast("bigint").alias("peak_process_tree_rss_bytes"),
        F.lit(None).cast("bigint").alias("peak_cuda_allocated_bytes"), F.lit(None).cast("bigint").alias("peak_cuda_reserved_bytes"),
        F.when(F.col(c).isNull(), "unavailable").otherwise("measured").alias("process_memory_status"), F.lit("unavailable").alias("cuda_memory_status"), F.lit(step).alias("sample_interval_s"),
    )
    rows = timed(spark, d).withColumn("condition", F.when(F.col("frac") == 1.0, "isolated").otherwise("contended"))
    out = Q.resource_fields(rows.withColumn("a", seen("selection", 0.5)).withColumn("b", seen("evaluation", 0.25)), "a", "b", "condition")
    peak = lambda c: F.col(c).cast("double").alias(c)
    return out.select(
        "model", "frac", "data_seed", "model_seed", "split_seed", peak("selection_peak_process_rss_bytes"), "selection_resource_status", peak("evaluation_peak_process_rss_bytes"),
        "evaluation_resource_status", "selected_fit_resource_status", "resource_sample_interval_s", "resource_cost_usable",
    )


@C.add("prj23_summary_rows", TIMED_SQL + """ SELECT model, frac, data_seed, model_seed, split_seed, round(test_nll, 6) AS test_nll_per_token, round(exp(test_nll), 6) AS test_perplexity, round(selected_fit + selected_validation, 6) AS train_time_sec, 'unknown' AS device
  FROM timed JOIN runs USING (model, frac, data_seed, model_seed, split_seed)""")
def prj23(spark, d):
    """Summary rows projected from nested results of fit and evaluation."""
    keys = ["model", "frac", "data_seed", "model_seed", "split_seed"]
    fit = timed(spark, d).select(*keys, F.struct(F.array(F.struct("selected_fit", "selected_validation")).alias("train_log")).alias("fit"))
    both = fit.join(runs(spark, d).select(*keys, F.struct("test_nll", F.lit(None).cast("string").alias("device")).alias("eval")), keys)
    spent = F.aggregate("fit.train_log", F.lit(0.0), lambda s, x: s + x["selected_fit"] + x["selected_validation"])
    return both.select(
        *keys, F.round("eval.test_nll", 6).alias("test_nll_per_token"), F.round(F.exp("eval.test_nll"), 6).alias("test_perplexity"), F.round(spent, 6).alias("train_time_sec"),
        F.coalesce("eval.device", F.lit("unknown")).alias("device"),
    )


@C.add("jon17_structural_status", BOUNDARY_SQL + f""", {METRICS_SQL}, sc AS (SELECT DISTINCT model, piece_id FROM metrics WHERE model IS NOT NULL AND frac = 1.0 AND nll IS NOT NULL),
  f AS (SELECT model, avg(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END) AS f1 FROM sc JOIN s USING (piece_id) GROUP BY 1),
  p AS (SELECT model, avg(nll) AS nll FROM metrics WHERE model IS NOT NULL AND frac = 1.0 AND nll IS NOT NULL GROUP BY 1)
  SELECT model, round(nll, 6) AS nll, round(f1, 6) AS f1, CASE WHEN bool_and(f1 IS NOT NULL) OVER () THEN 'comparable' ELSE 'incomparable' END AS status FROM p LEFT JOIN f USING (model)""")
def jon17(spark, d):
    """Boundary F1 over the pieces each model scored, joined to its NLL; one model without F1 makes all incomparable."""
    scored = metrics(spark, d).where("model is not null and frac = 1.0 and nll is not null")
    f1 = T.boundary_scores(boundaries(spark, d), "piece_id", "reference", "predicted", digits=12).select("piece_id", "f1")
    structure = scored.select("model", "piece_id").distinct().join(f1, "piece_id").groupBy("model").agg(F.avg("f1").alias("f1"))
    points = scored.groupBy("model").agg(F.avg("nll").alias("nll")).join(structure, "model", "left")  # a row a model
    whole = F.bool_and(F.col("f1").isNotNull()).over(Window.partitionBy())
    return points.select("model", F.round("nll", 6).alias("nll"), F.round("f1", 6).alias("f1"), F.when(whole, "comparable").otherwise("incomparable").alias("status"))


@C.add("dq01_config_issues", """SELECT * FROM (VALUES ('good', 0, ''), ('unknown', 2, 'representation not supported;context not above one'), ('bins', 1, 'duration bins not increasing'),
  ('levels', 3, 'metrical levels repeat;least window above the context;ratios do not sum to one'), ('bare', 3, 'alternative representation not supported;no metrical level;stride not positive')) t(name, n, issues)""")
def dq01(spark, d):
    """Settings of representation, windows and split held against their rules."""
    rows = [
        ("good", "pitch_class", None, [0.25, 1.0], ["beat"], 64, 32, 64, 8, 0.8, 0.1, 0.1), ("unknown", "melody", None, [0.25, 1.0], ["beat"], 1, 1, 1, 1, 0.8, 0.1, 0.1),
        ("bins", "pitch_class_duration", None, [1.0, 0.25], ["beat"], 64, 32, 64, 8, 0.8, 0.1, 0.1), ("levels", "pitch_class", None, [1.0], ["beat", "beat"], 64, 32, 64, 80, 0.8, 0.1, 0.2),
        ("bare", "pitch_class", "words", [1.0], [], 64, 0, 64, 8, 0.8, 0.1, 0.1),
    ]
    schema = "name string, representation string, alternative string, duration_bins array<double>, metrical_levels array<string>, context int, train_stride int, eval_stride int, least_window int, train_ratio double, validation_ratio double, test_ratio double"
    return spark.createDataFrame(rows, schema).withColumn("i", N.config_issues()).select("name", F.size("i").alias("n"), F.array_join("i", ";").alias("issues"))


@C.add("src18_collected_runs", RUNS_SQL + """ SELECT model || '-' || frac || '-' || data_seed || '-' || model_seed || '-' || split_seed AS run, CASE WHEN frac > 0.2 THEN round(test_nll, 6) END AS test_nll, n_tokens, CASE WHEN frac > 0.2 THEN 'complete' ELSE 'partial' END AS status
  FROM runs WHERE data_seed IS NOT NULL AND model_seed IS NOT NULL AND split_seed IS NOT NULL AND frac IS NOT NULL""")
def src18(spark, d):
    """Runs written as folders of JSON, some without a summary, and collected again with what each has."""
    root = scratch_folder(spark, "suite")
    r = runs(spark, d).where("data_seed is not null and model_seed is not null and split_seed is not null and frac is not null")
    r = r.select(F.concat_ws("-", "model", F.col("frac").cast("string"), F.col("data_seed").cast("string"), "model_seed", F.col("split_seed").cast("string")).alias("run"), "frac", F.round("test_nll", 6).alias("test_nll"), "n_tokens")
    r.select(F.to_json(F.struct("n_tokens")).alias("value"), "run", F.lit("config").alias("kind")).write.partitionBy("kind", "run").text(root)
    r.where("frac > 0.2").select(F.to_json(F.struct("test_nll")).alias("value"), "run", F.lit("summary").alias("kind")).write.mode("append").partitionBy("kind", "run").text(root)
    return catalogs.collect_runs(spark, root, {"config": "n_tokens bigint", "summary": "test_nll double"}).select("run", "test_nll", "n_tokens", "status")


@C.add("src17_full_perplexity", RUNS_SQL + " SELECT model, round(exp(avg(test_nll)), 6) AS perplexity FROM runs WHERE abs(frac - 1) <= 1e-9 GROUP BY 1")
def src17(spark, d):
    """The summary table as a figure reads it: CSV text, cast, at the whole fraction."""
    folder = scratch_folder(spark, "summary")
    summary = runs(spark, d).groupBy("model", "frac").agg(F.avg("test_nll").alias("mean_test_nll"))
    sinks.write_csv(summary, folder)
    text = spark.read.csv(folder, header=True)
    full = F.abs(F.col("frac").try_cast("double") - 1) <= 1e-9
    return text.where(full).select("model", F.round(F.exp(F.col("mean_test_nll").try_cast("double")), 6).alias("perplexity"))


@C.add("snk02_csv_json", "SELECT count(*) AS n_csv, count(*) AS n_json, round(sum(target_share), 6) AS total FROM mix_targets")
def snk02(spark, d):
    """A table as CSV and as one indented JSON document, both read again."""
    targets, folder = table(spark, d, "mix_targets"), scratch_folder(spark, "targets")
    sinks.write_csv(targets, f"{folder}/csv")
    sinks.write_json(spark, f"{folder}/json", [r.asDict() for r in targets.collect()])  # a fixed table of few rows
    a = spark.read.csv(f"{folder}/csv", header=True).agg(F.count(F.lit(1)).alias("n_csv"), F.round(F.sum(F.col("target_share").cast("double")), 6).alias("total"))
    b = spark.read.json(f"{folder}/json", multiLine=True).agg(F.count(F.lit(1)).alias("n_json"))
    return a.crossJoin(b).select("n_csv", "n_json", "total")


@C.add("snk06_latex_rows", RUNS_SQL + """ SELECT model || ' & ' || printf('%.3f', avg(test_nll)) || ' & ' || count(*) || ' \\\\' AS line FROM runs WHERE frac = 1.0 GROUP BY model""")
def snk06(spark, d):
    """Body lines of a table to be typeset, numbers with three decimals."""
    rows = runs(spark, d).where("frac = 1.0").groupBy("model").agg(F.avg("test_nll").alias("nll"), F.count(F.lit(1)).alias("n"))
    return sinks.latex_rows(rows, "model", "nll", "n")


@C.add("snk07_markdown_rows", RUNS_SQL + """ SELECT '| ' || model || ' | ' || printf('%.3f', avg(test_nll)) || ' | ' || count(*) || ' |' AS line FROM runs WHERE frac = 1.0 GROUP BY model""")
def snk07(spark, d):
    """Body lines of a report's table."""
    rows = runs(spark, d).where("frac = 1.0").groupBy("model").agg(F.avg("test_nll").alias("nll"), F.count(F.lit(1)).alias("n"))
    return sinks.markdown_rows(rows, "model", "nll", "n")


@C.add("snk13_trace_by_seed", f"WITH {METRICS_SQL} SELECT CAST(data_seed AS INTEGER) AS data_seed, count(*) AS n, count(nll) AS n_scored FROM metrics WHERE data_seed IS NOT NULL GROUP BY 1")
def snk13(spark, d):
    """Traces written as CSV, a folder a seed, and read again with the union of their columns."""
    folder = scratch_folder(spark, "trace")
    metrics(spark, d).where("data_seed is not null").select("data_seed", "piece_id", "model", "nll").write.partitionBy("data_seed").csv(folder, header=True)
    rows = spark.read.csv(folder, header=True)
    return rows.groupBy(F.col("data_seed").cast("int").alias("data_seed")).agg(F.count(F.lit(1)).alias("n"), F.count("nll").alias("n_scored"))


def chord_parameters(spark) -> HM.Parameters:
    """The chord states as a hidden Markov model: even start, rule-based moves, emissions by chord and mode."""
    e, m = H.emissions(spark).toPandas(), H.transition_scores(spark).toPandas()  # 252 states
    emission, move = np.zeros((252, 12)), np.zeros((252, 252))
    emission[e["state"], e["pc"]], move[m["i"], m["j"]] = e["p"], m["p"]
    return HM.Parameters(np.full(252, 1 / 252), move, emission)


def chord_paths(spark, d):
    sequences = pitch_sequences(spark, d).withColumn("tokens", F.transform("tokens", lambda x: F.pmod(x, F.lit(12))))
    p = chord_parameters(spark)
    return HM.viterbi(sequences, p, HM.Relations(HM.log_floor(p.transition), H.move_relations()))


@C.add("hmm04_chord_segments")
def hmm04(spark, d):
    """Every piece decoded over the 252 chord states, as segments with their chord."""
    names = H.chord_states(spark).select("state", "label")
    return S.segments(chord_paths(spark, d), "piece_id", "t", "state").join(F.broadcast(names), "state").select("piece_id", "start", "stop", F.col("label").alias("chord"))


@C.add("hmm04_chord_moves")
def hmm04b(spark, d):
    """Empirical moves between decoded chords, by probability."""
    moves = S.transitions(chord_paths(spark, d), "piece_id", "t", "state")
    return moves.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("i")), 6)).select("i", "j", "n", "p")


@C.add("hmm04_likelihood")
def hmm04c(spark, d):
    """Log likelihood of every piece under the chord model."""
    sequences = pitch_sequences(spark, d).withColumn("tokens", F.transform("tokens", lambda x: F.pmod(x, F.lit(12))))
    return HM.log_likelihoods(sequences, chord_parameters(spark)).select("piece_id", "n", F.round("ll", 6).alias("ll"))


@C.add("strm4_live_bigrams", "SELECT first, second, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, value) AS first, event_type AS second FROM events) WHERE first IS NOT NULL GROUP BY 1, 2")
def strm4b(spark, d):
    """Pairs of successive events of each user from a stream, the last event kept as state."""
    source = ST.file_stream(spark, f"{d.rstrip('/')}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ST.run_all(ST.live_ngrams(source, "user_id", ["ts", "value"], "event_type", 2), scratch_folder(spark, "bigrams"), scratch_folder(spark, "state"))
    return out.groupBy(F.get("gram", F.lit(0)).alias("first"), F.get("gram", F.lit(1)).alias("second")).agg(F.count(F.lit(1)).alias("n"))


@C.add("strm4_live_segments", """WITH l AS (SELECT user_id, ts, value, event_type, lag(event_type) OVER w IS DISTINCT FROM event_type AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)),
  r AS (SELECT user_id, event_type, sum(CAST(c AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, value) AS run FROM l), g AS (SELECT user_id, event_type, run, count(*) AS length, max(run) OVER (PARTITION BY user_id) AS last FROM r GROUP BY 1, 2, 3)
  SELECT event_type, CAST(length AS BIGINT) AS length, count(*) AS n FROM g WHERE run < last GROUP BY 1, 2""")
def strm4c(spark, d):
    """Closed runs of equal events of each user from a stream; the run still open is kept as state."""
    source = ST.file_stream(spark, f"{d.rstrip('/')}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ST.run_all(ST.live_segments(source, "user_id", ["ts", "value"], "event_type"), scratch_folder(spark, "segments"), scratch_folder(spark, "state"))
    return out.groupBy("event_type", "length").agg(F.count(F.lit(1)).alias("n"))


def write_artifacts(spark, d, root: str) -> None:
    """The runs as the artifacts of one experiment, a folder each: settings, checkpoint, raw rows, summary, protocol audit."""
    r = runs(spark, d).where("data_seed is not null and frac is not null and test_nll is not null")
    put = lambda name, df: df.coalesce(1).write.text(f"{root}/{name}")  # noqa: E731  # a row a run: small
    line = lambda *cs: F.concat_ws(",", *[F.col(c).cast("string") for c in cs])
    # one text with its header first
    csv = lambda df, *cs: df.agg(F.concat_ws("\n", F.lit(",".join(cs)), F.array_sort(F.collect_list(line(*cs)))).alias("value"))
    grid = r.agg(F.to_json(F.struct(F.collect_set("data_seed").alias("data_seeds"), F.collect_set("frac").alias("train_fractions"))).alias("value"))
    put("config.json", grid)
    put("checkpoint.jsonl", r.select(F.to_json(F.struct(F.concat_ws("/", F.col("data_seed").cast("string"), F.col("frac").cast("string")).alias("cell"))).alias("value")))
    put("results_raw.csv", csv(r, "model", "frac", "data_seed", "test_nll"))
    put("results_summary.csv", csv(r.groupBy("model", "frac").agg(F.avg("test_nll").alias("mean_test_nll"), F.count(F.lit(1)).alias("runs")), "model", "frac", "mean_test_nll", "runs"))
    put("protocol_audit.json", spark.createDataFrame([('{"status": "passed"}',)], "value string"))


@C.add("dq09_run_audit", RUNS_SQL + """, r AS (SELECT * FROM runs WHERE data_seed IS NOT NULL AND frac IS NOT NULL AND test_nll IS NOT NULL),
  g AS (SELECT count(DISTINCT data_seed) * count(DISTINCT frac) AS expected, count(DISTINCT (data_seed, frac)) AS done FROM r), c AS (SELECT CASE WHEN done < expected THEN 'incomplete' ELSE 'passed' END AS s FROM g)
  SELECT 'artifacts_present' AS check_name, 'passed' AS status, false AS advisory UNION ALL SELECT 'json_parsable', 'passed', false UNION ALL SELECT 'cells_completed', s, false FROM c UNION ALL SELECT 'summary_matches_raw', 'passed', false
  UNION ALL SELECT 'config_matches_rows', 'passed', false UNION ALL SELECT 'run_summary_present', 'incomplete', true UNION ALL SELECT 'overall', s, false FROM c""")
def dq09(spark, d):
    """The artifacts of an experiment written from the runs, read again and held against each other."""
    root = scratch_folder(spark, "experiment")
    write_artifacts(spark, d, root)
    names = ["config.json", "checkpoint.jsonl", "results_raw.csv", "results_summary.csv", "protocol_audit.json"]
    return A.audit_run(A.artifacts(spark, root), names, ["config.json", "protocol_audit.json", "run_summary.json"])


@C.add("dq14_requirements", TIMED_SQL + """, u AS (SELECT model, selection, evaluation FROM timed WHERE frac = 1.0), m AS (SELECT count(DISTINCT model) AS n FROM runs WHERE model IS NOT NULL)
  SELECT 'settings' AS requirement, 'passed' AS status UNION ALL SELECT 'report', 'incomplete' UNION ALL SELECT 'package', 'passed' UNION ALL SELECT 'config_of_runs', 'passed'
  UNION ALL SELECT 'tokens_of_runs', CASE WHEN (SELECT count(*) FROM runs WHERE n_tokens IS NULL OR n_tokens <= 0) > 0 THEN 'failed' ELSE 'passed' END
  UNION ALL SELECT 'tests', 'passed' UNION ALL SELECT 'more_tests', 'partial'
  UNION ALL SELECT 'costs', CASE WHEN (SELECT count(DISTINCT model) FROM u) = (SELECT n FROM m) AND (SELECT count(*) FROM u WHERE selection IS NULL OR evaluation IS NULL) = 0 THEN 'passed' ELSE 'partial' END
  UNION ALL SELECT 'scenarios', 'passed'""")
def dq14(spark, d):
    """Seven kinds of requirement held against artifacts made from the runs."""
    root = scratch_folder(spark, "evidence")
    write_artifacts(spark, d, root)
    files = A.artifacts(spark, root)
    report = spark.createDataFrame([("tests.json", json.dumps({"status": "passed", "tests_run": 2, "test_ids": ["test_split", "test_cost"]}))], files.schema)
    each = runs(spark, d).select(
        F.concat_ws("-", "model", F.col("frac").cast("string"), F.col("data_seed").cast("string"), "model_seed", F.col("split_seed").cast("string")).alias("run"), F.lit("config.json").alias("name"),
        F.to_json(F.struct((F.coalesce("n_tokens", F.lit(0)) > 0).cast("string").alias("scored"))).alias("text"),
    )
    manifest = sinks.file_manifest(spark, root)
    models = [r["model"] for r in runs(spark, d).where("model is not null").select("model").distinct().orderBy("model").collect()]  # a row a model
    costs = timed(spark, d).withColumn("resource_measurement_condition", F.lit("isolated")).withColumn("resource_cost_usable", F.lit(True))
    context = {
        "files": files.unionByName(report), "package": sinks.compare_manifests(manifest, manifest), "runs": each, "costs": costs,
        "scenarios": Q.protocol_costs(timed(spark, d)).select(F.col("total").alias("cost")),
    }
    rules = [
        {"name": "settings", "type": "context_file_exists", "file": "config.json"}, {"name": "report", "type": "context_file_exists", "file": "report.md", "missing_status": "incomplete"},
        {"name": "package", "type": "package_verified"}, {"name": "config_of_runs", "type": "files_in_each_run", "file": "config.json"},
        {"name": "tokens_of_runs", "type": "json_field_in_each_run", "file": "config.json", "field": "scored", "allowed": ["true"]},
        {"name": "tests", "type": "test_report_passed", "file": "tests.json", "fragments": ["split"]}, {"name": "more_tests", "type": "test_report_passed", "file": "tests.json", "fragments": ["stream"]},
        {"name": "costs", "type": "resource_costs_complete", "models": models, "fields": ["selection", "evaluation"]}, {"name": "scenarios", "type": "cost_scenarios_computed"},
    ]
    out = [A.requirement(rule, context) for rule in rules]
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    return out[0]
