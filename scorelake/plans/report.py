"""Queries that compose others: analysis tables, run audits, requirements."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.operators import harmony as H
from scorelake.operators import hidden_markov as HM
from scorelake.operators import sequences as S
from scorelake.operators import statistics as T
from scorelake.plans.common import Catalogue
from scorelake.plans.metrics import RUNS_SQL, runs
from scorelake.plans.models import HAR_SQL, VITERBI_SQL, hdp_grid, hmm_grid, pitch_sequences
from scorelake.sources.relations import EVENTS_SQL, METRICS_SQL, PIECES_SQL, RECORDS_SQL, TOKENS_SQL, events, metrics, pieces, records, tokens
from scorelake.sources.tables import table

C = Catalogue()


@C.add("prj01_ordered_events", f"""WITH {EVENTS_SQL} SELECT piece_id, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY "offset", kind, t) - 1 AS INTEGER) AS index, kind, CAST(len(midi_pitches) AS INTEGER) AS n_pitches FROM ev""")
def prj01(spark, d):
    """Events in order of time, then notes after chords, numbered densely."""
    by = Window.partitionBy("piece_id").orderBy("offset", "kind", "t")
    return events(spark, d).select("piece_id", (F.row_number().over(by) - 1).alias("index"), "kind", F.size("midi_pitches").alias("n_pitches"))


@C.add("prj02_catalog_rows", f"""WITH {RECORDS_SQL}, {EVENTS_SQL}, n AS (SELECT piece_id, count(*) AS n FROM ev GROUP BY 1), x AS (SELECT piece_id, min(reason) AS reason FROM exclusion_records GROUP BY 1)
  SELECT piece_id, r.title, n.n AS n_events, coalesce(x.reason, '') AS error FROM records r LEFT JOIN n USING (piece_id) LEFT JOIN x USING (piece_id)""")
def prj02(spark, d):
    """A row a score: counts where it could be read, else why not."""
    n = events(spark, d).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n_events"))
    x = table(spark, d, "exclusion_records").groupBy("piece_id").agg(F.min("reason").alias("error"))
    r = records(spark, d).select("piece_id", "title")
    return r.join(n, "piece_id", "left").join(x, "piece_id", "left").select("piece_id", "title", "n_events", F.coalesce("error", F.lit("")).alias("error"))


@C.add("prj03_part_selection", f"""WITH {EVENTS_SQL}, h AS (SELECT *, midi >= 60 AS high FROM ev) SELECT piece_id, t, midi FROM (SELECT *, bool_or(high) OVER (PARTITION BY piece_id, measure) AS any_high FROM h WHERE measure IS NOT NULL) WHERE high OR NOT any_high""")
def prj03(spark, d):
    """In each measure the upper notes if there are any, else all: a choice by window."""
    rows = events(spark, d).where("measure is not null").withColumn("high", F.col("midi") >= 60)
    some = F.bool_or("high").over(Window.partitionBy("piece_id", "measure"))
    return rows.withColumn("any_high", some).where(F.col("high") | ~F.col("any_high")).select("piece_id", "t", "midi")


@C.add("prj04_merged_streams", f"""WITH {EVENTS_SQL}, u AS (SELECT piece_id, t, "offset", 'note' AS part FROM ev WHERE kind = 'note' UNION ALL SELECT piece_id, t, "offset", 'chord' FROM ev WHERE kind = 'chord')
  SELECT piece_id, part, t, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY "offset", part, t) - 1 AS INTEGER) AS place FROM u""")
def prj04(spark, d):
    """Two streams of a piece merged into one in order of time."""
    e = events(spark, d).select("piece_id", "t", "offset", "kind")
    both = e.where("kind = 'note'").unionByName(e.where("kind = 'chord'")).withColumnRenamed("kind", "part")
    return both.select("piece_id", "part", "t", (F.row_number().over(Window.partitionBy("piece_id").orderBy("offset", "part", "t")) - 1).alias("place"))


@C.add("prj06_observations", f"WITH {EVENTS_SQL} SELECT piece_id, t, pc AS token, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][pc + 1] AS observation, measure FROM ev WHERE pc IS NOT NULL")
def prj06(spark, d):
    names = F.array(*[F.lit(x) for x in H.NAMES])
    return events(spark, d).where("pc is not null").select("piece_id", "t", F.col("pc").alias("token"), F.element_at(names, F.col("pc") + 1).alias("observation"), "measure")


@C.add("prj07_state_labels", VITERBI_SQL + " SELECT ev.piece_id, ev.t, ev.label, 'state ' || state AS state_label FROM ev JOIN b ON b.piece_id = ev.piece_id AND b.t = ev.t")
def prj07(spark, d):
    """Decoded states beside the events they explain."""
    z = HM.viterbi(pitch_sequences(spark, d), HM.example_parameters())
    label = F.concat(F.lit("state "), F.col("state").cast("string"))
    return events(spark, d).select("piece_id", "t", "label").join(z, ["piece_id", "t"]).select("piece_id", "t", "label", label.alias("state_label"))


@C.add("prj17_active_submatrix", f"""WITH {EVENTS_SQL}, p AS (SELECT pc AS i, lead(pc) OVER (PARTITION BY piece_id ORDER BY t) AS j FROM ev), n AS (SELECT i, j, count(*) AS n FROM p WHERE i IS NOT NULL AND j IS NOT NULL GROUP BY ALL),
  a AS (SELECT pc FROM ev WHERE pc IS NOT NULL GROUP BY 1 HAVING count(*) > (SELECT count(*) / 12.0 FROM ev)) SELECT i, j, n FROM n WHERE i IN (SELECT pc FROM a) AND j IN (SELECT pc FROM a)""")
def prj17(spark, d):
    """Moves among the states used more than evenly."""
    use = events(spark, d).where("pc is not null").groupBy("pc").agg(F.count(F.lit(1)).alias("n"))
    total = events(spark, d).agg(F.count(F.lit(1)).alias("total"))
    active = use.join(F.broadcast(total)).where(F.col("n") > F.col("total") / 12.0).select("pc")
    moves = S.transitions(events(spark, d), "piece_id", "t", "pc")
    return moves.join(active.withColumnRenamed("pc", "i"), "i", "left_semi").join(active.withColumnRenamed("pc", "j"), "j", "left_semi").select("i", "j", "n")


NAMED = {"finite_hmm": "Finite HMM", "hdp_hmm": "HDP-HMM", "vomm": "Back-off Markov"}


@C.add("prj18_display_names", f"WITH {METRICS_SQL} SELECT DISTINCT model, CASE model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMED.items()) + " ELSE model END AS display FROM metrics WHERE model IS NOT NULL")
def prj18(spark, d):
    mapping = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
    return metrics(spark, d).where("model is not null").select("model", F.coalesce(F.try_element_at(mapping, F.col("model")), "model").alias("display")).distinct()


@C.add("prj22_run_filter", RUNS_SQL + " SELECT model, frac, data_seed FROM runs WHERE frac = 1.0 AND data_seed = (SELECT min(data_seed) FROM runs)")
def prj22(spark, d):
    r = runs(spark, d)
    first = r.agg(F.min("data_seed").alias("data_seed"))
    return r.where("frac = 1.0").join(F.broadcast(first), "data_seed", "left_semi").select("model", "frac", "data_seed")


@C.add("jon14_paired_arrays", f"""WITH {PIECES_SQL}, {EVENTS_SQL}, e AS (SELECT piece_id, count(*) AS n, list(pc ORDER BY t) AS pcs FROM ev GROUP BY 1)
  SELECT piece_id, CAST(n AS INTEGER) AS n, CAST(len(list_filter(range(1, n + 1), lambda i: tokens[i] // 5 = pcs[i])) AS INTEGER) AS n_equal FROM e JOIN pieces USING (piece_id) WHERE n = len(tokens)""")
def jon14(spark, d):
    """Two sequences of a piece side by side; pieces of unequal length are left out."""
    e = events(spark, d).groupBy("piece_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "pc"))), lambda x: x["pc"]).alias("pcs"))
    same = F.filter(F.arrays_zip("tokens", "pcs"), lambda x: F.floor(x["tokens"] / 5) == x["pcs"])
    return pieces(spark, d).select("piece_id", "tokens").join(e, "piece_id").where(F.size("tokens") == F.size("pcs")).select("piece_id", F.size("tokens").alias("n"), F.size(same).alias("n_equal"))


@C.add("agg31_posterior_mean")
def agg31(spark, d):
    """Mean emission of the kept samples of the selected chain; symbol 12 starts a piece."""
    _, p, _ = hdp_grid(spark, d)
    return spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(p.emission)], "state int, pc int, p double")


@C.add("agg40_structural_metrics")
def agg40(spark, d):
    """Boundary scores of the decoded states, averaged over pieces."""
    z = HM.viterbi(pitch_sequences(spark, d), HM.example_parameters())
    predicted = S.segments(z, "piece_id", "t", "state").where("start > 0").groupBy("piece_id").agg(F.collect_list("start").alias("predicted"))
    by = Window.partitionBy("piece_id").orderBy("t")
    marks = events(spark, d).where("measure is not null").withColumn("new", F.col("measure") != F.lag("measure").over(by)).where("new")
    reference = marks.groupBy("piece_id").agg(F.collect_list("t").alias("reference"))
    both = T.boundary_scores(reference.join(predicted, "piece_id"), "piece_id", "reference", "predicted", 1)
    return both.agg(F.count(F.lit(1)).alias("n_pieces"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])


@C.add("win15_stick_weights", f"""WITH {TOKENS_SQL}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY 1), v AS (SELECT token, n / sum(n) OVER (ORDER BY token ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM c),
  w AS (SELECT token, v, sum(CASE WHEN v < 1 THEN ln(1 - v) ELSE 0 END) OVER (ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v) SELECT token, round(v * exp(coalesce(b, 0)), 6) AS weight FROM w""")
def win15(spark, d):
    """Shares of the tokens as broken sticks: what each takes of what is left."""
    c = tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    left = F.sum("n").over(Window.partitionBy("one").orderBy("token").rowsBetween(0, Window.unboundedFollowing))  # one row a token of the vocabulary
    return S.stick_breaking(c.withColumn("v", F.col("n") / left), "one", "token", "v").select("token", F.round("weight", 6).alias("weight"))


@C.add("win18_adjacent_repeats", f"WITH {EVENTS_SQL} SELECT piece_id, count(*) AS n FROM (SELECT piece_id, label, lead(label) OVER (PARTITION BY piece_id ORDER BY label, t) AS next FROM ev) WHERE label = next GROUP BY 1")
def win18(spark, d):
    """Equal neighbours among sorted values."""
    following = F.lead("label").over(Window.partitionBy("piece_id").orderBy("label", "t"))
    return events(spark, d).select("piece_id", "label", following.alias("next")).where("label = next").groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"))


@C.add("win19_top_successors", f"""WITH {EVENTS_SQL}, p AS (SELECT pc AS i, lead(pc) OVER (PARTITION BY piece_id ORDER BY t) AS j FROM ev), n AS (SELECT i, j, count(*) AS n FROM p WHERE i IS NOT NULL AND j IS NOT NULL GROUP BY ALL)
  SELECT i, j, CAST(place AS INTEGER) AS place, round(p, 6) AS p FROM (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS p, row_number() OVER (PARTITION BY i ORDER BY n DESC, j) AS place FROM n) WHERE place <= 3""")
def win19(spark, d):
    """The three likeliest successors of each state."""
    by = Window.partitionBy("i")
    moves = S.transitions(events(spark, d), "piece_id", "t", "pc").withColumn("p", F.col("n") / F.sum("n").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), "j")))
    return moves.where("place <= 3").select("i", "j", "place", F.round("p", 6).alias("p"))


@C.add("srt02_head", f"WITH {RECORDS_SQL} SELECT piece_id FROM records ORDER BY piece_id LIMIT 25")
def srt02(spark, d):
    """The head of a list: the limit is the feature."""
    return records(spark, d).select("piece_id").orderBy("piece_id").limit(25)


@C.add("srt04_top_of_group", f"WITH {PIECES_SQL} SELECT source, piece_id, CAST(n AS INTEGER) AS n FROM (SELECT split_part(piece_id, '/', 1) AS source, piece_id, len(tokens) AS n, row_number() OVER (PARTITION BY split_part(piece_id, '/', 1) ORDER BY len(tokens) DESC, piece_id) AS place FROM pieces) WHERE place <= 3")
def srt04(spark, d):
    """The three longest pieces of each source."""
    rows = pieces(spark, d).select(F.substring_index("piece_id", "/", 1).alias("source"), "piece_id", F.size("tokens").alias("n"))
    by = Window.partitionBy("source").orderBy(F.desc("n"), "piece_id")
    return rows.withColumn("place", F.row_number().over(by)).where("place <= 3").select("source", "piece_id", "n")


@C.add("srt13_sampled_tokens", f"""WITH {TOKENS_SQL} SELECT piece_id, arg_max(token, struct_pack(h := md5('8:' || piece_id || ':' || t), t := -t)) AS token FROM tok GROUP BY 1""")
def srt13(spark, d):
    """One token of each piece drawn by its count: the one with the largest hash."""
    key = F.struct(F.md5(F.concat_ws(":", F.lit("8"), "piece_id", F.col("t").cast("string"))), -F.col("t"))
    return tokens(spark, d).groupBy("piece_id").agg(F.max_by("token", key).alias("token"))


@C.add("sta07_structural_status", "SELECT 'not_evaluated' AS status WHERE (SELECT count(*) FROM musical_events WHERE measure IS NOT NULL) = 0 UNION ALL SELECT 'evaluated' WHERE (SELECT count(*) FROM musical_events WHERE measure IS NOT NULL) > 0")
def sta07(spark, d):
    """Whether there are boundaries to evaluate against."""
    n = table(spark, d, "musical_events").agg(F.count("measure").alias("n"))
    return n.select(F.when(F.col("n") > 0, "evaluated").otherwise("not_evaluated").alias("status"))


@C.add("har04_profiles", f"WITH {EVENTS_SQL}, c AS (SELECT piece_id, pc, count(*) AS n FROM ev WHERE pc IS NOT NULL GROUP BY 1, 2) SELECT piece_id, pc, round(n / sum(n) OVER (PARTITION BY piece_id), 6) AS share FROM c")
def har04(spark, d):
    """The share of each pitch class in each piece."""
    c = events(spark, d).where("pc is not null").groupBy("piece_id", "pc").agg(F.count(F.lit(1)).alias("n"))
    return c.select("piece_id", "pc", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("piece_id")), 6).alias("share"))


@C.add("har07_projected_profile", f"WITH {TOKENS_SQL} SELECT pc, round(n / sum(n) OVER (), 6) AS share FROM (SELECT CAST(token // 5 AS BIGINT) AS pc, count(*) AS n FROM tok GROUP BY 1)")
def har07(spark, d):
    """Tokens of pitch and duration summed to pitch classes."""
    c = tokens(spark, d).groupBy(F.floor(F.col("token") / 5).alias("pc")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("pc", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # twelve rows


@C.add("set06_emission_support", HAR_SQL + " SELECT state, CAST(len(tones) AS INTEGER) AS n_chord, CAST(len(list_filter(coalesce(modal, []), lambda x: NOT list_contains(tones, x))) AS INTEGER) AS n_modal FROM st LEFT JOIN sup USING (state)")
def set06(spark, d):
    """Tones of each chord, and those its modes add."""
    scales = {m: F.array(*[F.lit(x) for x in s]) for m, s in H.MODES.items()}
    states = H.chord_states(spark)
    around = lambda m: F.transform(scales[m], lambda x: F.pmod(x + F.col("root"), F.lit(12)))
    none = F.array().cast("array<int>")
    support = none
    for m in H.MODES:
        support = F.array_union(support, F.when(F.array_contains("modes", m), around(m)).otherwise(none))
    return states.select("state", F.size("tones").alias("n_chord"), F.size(F.array_except(support, "tones")).alias("n_modal"))


@C.add("mth01_normalised_rows", f"""WITH {EVENTS_SQL}, p AS (SELECT pc AS i, lead(pc) OVER (PARTITION BY piece_id ORDER BY t) AS j FROM ev), n AS (SELECT i, j, count(*) AS n FROM p WHERE i IS NOT NULL AND j IS NOT NULL GROUP BY ALL)
  SELECT i, round(-sum(q * ln(q)), 6) AS entropy, round(ln(sum(exp(ln(n)))), 6) AS log_total FROM (SELECT *, n / sum(n) OVER (PARTITION BY i) AS q FROM n) GROUP BY 1""")
def mth01(spark, d):
    """Rows of the transition matrix normalised: their entropy and log-sum-exp."""
    moves = S.transitions(events(spark, d), "piece_id", "t", "pc").withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("i")))
    top = F.max(F.ln("n"))
    rows = moves.groupBy("i").agg(F.sum(-F.col("q") * F.ln("q")).alias("e"), top.alias("m"), F.collect_list(F.ln("n")).alias("l"))  # at most twelve a row
    total = F.col("m") + F.ln(F.aggregate(F.transform("l", lambda x: F.exp(x - F.col("m"))), F.lit(0.0), lambda a, x: a + x))
    return rows.select("i", F.round("e", 6).alias("entropy"), F.round(total, 6).alias("log_total"))


@C.add("mth14_argmax", f"WITH {PIECES_SQL} SELECT piece_id, CAST(list_position(tokens, list_max(tokens)) - 1 AS INTEGER) AS first_of_largest FROM pieces WHERE len(tokens) > 0")
def mth14(spark, d):
    """The lowest index of the largest value."""
    return pieces(spark, d).where(F.size("tokens") > 0).select("piece_id", (F.array_position("tokens", F.array_max("tokens")) - 1).cast("int").alias("first_of_largest"))


@C.add("mth07_half_even", f"WITH {RECORDS_SQL} SELECT split_part(piece_id, '/', 1) AS source, CAST(round_even(count(*) * 0.25, 0) AS BIGINT) AS quarter FROM records GROUP BY 1")
def mth07(spark, d):
    """Counts rounded half to even."""
    return records(spark, d).groupBy(F.substring_index("piece_id", "/", 1).alias("source")).agg(F.bround(F.count(F.lit(1)) * 0.25).cast("bigint").alias("quarter"))


@C.add("cmp01_result_table", RUNS_SQL + " SELECT model, frac, count(*) AS n_runs, round(min(test_nll), 6) AS best, round(max(test_nll), 6) AS worst, round(exp(avg(test_nll)), 6) AS perplexity FROM runs GROUP BY 1, 2")
def cmp01(spark, d):
    return runs(spark, d).groupBy("model", "frac").agg(
        F.count(F.lit(1)).alias("n_runs"), F.round(F.min("test_nll"), 6).alias("best"), F.round(F.max("test_nll"), 6).alias("worst"), F.round(F.exp(F.avg("test_nll")), 6).alias("perplexity")
    )


@C.add("cmp05_capacity")
def cmp05(spark, d):
    """Validation NLL by the number of states, and whether the largest is best."""
    best, _, log = hmm_grid(spark, d)
    verdict = "grid_too_small" if best == max(log) else "grid_informative"
    return spark.createDataFrame([(k, round(nll, 6), k == best, verdict) for k, (nll, _) in log.items()], "states int, validation_nll double, best boolean, verdict string")
