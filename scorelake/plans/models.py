"""Queries on sequence models: back-off Markov, hidden Markov, harmony."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.operators import harmony as H
from scorelake.operators import hidden_markov as HM
from scorelake.operators import markov as V
from scorelake.operators import sequences as S
from scorelake.operators.statistics import boundary_scores
from scorelake.plans.common import Catalogue
from scorelake.sources.relations import EVENTS_SQL, RECORDS_SQL, TOKENS_SQL, events, pieces, records, tokens

C = Catalogue()
BOS, DEPTH, SLICE = 60, 2, 32
ORDERS = (1, 2, 4, 8)  # candidates of the selection


def part(spark, d, split: str):
    """Tokens of the pieces of one split."""
    return tokens(spark, d).join(records(spark, d).where(F.col("split") == split).select("piece_id"), "piece_id", "left_semi")


TRAIN_SQL = f"""WITH {TOKENS_SQL}, {RECORDS_SQL}, tr AS (SELECT tok.* FROM tok JOIN records USING (piece_id) WHERE split = 'train'),
  l AS (SELECT token, t AS p, lag(token, 1) OVER w AS l1, lag(token, 2) OVER w AS l2 FROM tr WINDOW w AS (PARTITION BY piece_id ORDER BY t)),
  g AS (SELECT 0 AS k, '' AS context, token FROM l UNION ALL SELECT 1, CAST(coalesce(l1, 60) AS VARCHAR), token FROM l UNION ALL SELECT 2, CASE WHEN p = 1 THEN '60' ELSE CAST(l2 AS VARCHAR) END || ',' || l1, token FROM l WHERE p >= 1),
  c AS (SELECT k, context, token, count(*) AS n FROM g GROUP BY ALL), tot AS (SELECT k, context, sum(n) AS total FROM c GROUP BY ALL),"""
SCORE_SQL = TRAIN_SQL + """
  te AS (SELECT tok.*, t % 32 AS q FROM tok JOIN records USING (piece_id) WHERE split = '{split}'),
  x AS (SELECT piece_id, t, token, q, CASE WHEN q = 0 THEN '60' ELSE CAST(lag(token, 1) OVER w AS VARCHAR) END AS c1,
    CASE WHEN q = 0 THEN NULL WHEN q = 1 THEN '60,' || lag(token, 1) OVER w ELSE lag(token, 2) OVER w || ',' || lag(token, 1) OVER w END AS c2 FROM te WINDOW w AS (PARTITION BY piece_id ORDER BY t)),
  ctx AS (SELECT DISTINCT c1, c2 FROM x), sym AS (SELECT s FROM range(61) r(s)),
  d0 AS (SELECT c1, c2, s, (coalesce(a.n, 0) + 0.5) / (t0.total + 30.5) AS p FROM ctx CROSS JOIN sym CROSS JOIN (SELECT total FROM tot WHERE k = 0) t0 LEFT JOIN c a ON a.k = 0 AND a.token = s),
  d1 AS (SELECT d0.c1, d0.c2, s, CASE WHEN t1.total IS NULL THEN p ELSE t1.total / (t1.total + 1) * (coalesce(a.n, 0) + 0.5) / (t1.total + 30.5) + (1 - t1.total / (t1.total + 1)) * p END AS p
    FROM d0 LEFT JOIN tot t1 ON t1.k = 1 AND t1.context = d0.c1 LEFT JOIN c a ON a.k = 1 AND a.context = d0.c1 AND a.token = s),
  d2 AS (SELECT d1.c1, d1.c2, s, CASE WHEN t2.total IS NULL THEN p ELSE t2.total / (t2.total + 1) * (coalesce(a.n, 0) + 0.5) / (t2.total + 30.5) + (1 - t2.total / (t2.total + 1)) * p END AS p
    FROM d1 LEFT JOIN tot t2 ON t2.k = 2 AND t2.context = d1.c2 LEFT JOIN c a ON a.k = 2 AND a.context = d1.c2 AND a.token = s),
  b AS (SELECT c1, c2, arg_max(s, struct_pack(p := round(p, 13), s := -s)) AS best, sum(p * p) AS sq FROM d2 GROUP BY ALL),
  sc AS (SELECT x.piece_id, x.t, x.token, d2.p AS probability, b.best, b.sq - 2 * d2.p + 1 AS brier FROM x JOIN d2 ON d2.c1 = x.c1 AND d2.c2 IS NOT DISTINCT FROM x.c2 AND d2.s = x.token JOIN b ON b.c1 = x.c1 AND b.c2 IS NOT DISTINCT FROM x.c2)"""
EVAL_SQL = "count(*) AS n_tokens, round(avg(-ln(greatest(probability, 1e-12))), 6) AS nll, round(exp(avg(-ln(greatest(probability, 1e-12)))), 6) AS perplexity, round(avg(CASE WHEN best = token THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(brier), 6) AS brier"


def scored(spark, d, split: str):
    model = V.fit(part(spark, d, "train"), DEPTH, BOS)
    return V.score(part(spark, d, split), model, DEPTH, BOS, SLICE)


@C.add("m0_vomm_piece_nll", SCORE_SQL.format(split="test") + f" SELECT piece_id, {EVAL_SQL} FROM sc GROUP BY 1")
def m0(spark, d):
    """The flagship: fit on train pieces, score every event of test pieces, per piece."""
    return V.evaluate(scored(spark, d, "test"), "piece_id")


@C.add("vom03_summary", SCORE_SQL.format(split="test") + f" SELECT {EVAL_SQL} FROM sc")
def vom03(spark, d):
    return V.evaluate(scored(spark, d, "test"))


@C.add("vom01_counts", TRAIN_SQL + " z AS (SELECT 1) SELECT k, count(*) AS cells, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1")
def vom01(spark, d):
    return V.fit(part(spark, d, "train"), DEPTH, BOS).groupBy("k").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("total"))


@C.add("vom02_probabilities", SCORE_SQL.format(split="validation") + " SELECT piece_id, t, round(probability, 6) AS probability FROM sc")
def vom02(spark, d):
    return scored(spark, d, "validation").select("piece_id", "t", F.round("probability", 6).alias("probability"))


@C.add("agg36_hit_rates", SCORE_SQL.format(split="test") + """, rk AS (SELECT c1, c2, s, row_number() OVER (PARTITION BY c1, c2 ORDER BY round(p, 13) DESC, s) AS place FROM d2),
  h AS (SELECT place FROM x JOIN rk ON rk.c1 = x.c1 AND rk.c2 IS NOT DISTINCT FROM x.c2 AND rk.s = x.token)
  SELECT count(*) AS n, round(avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3, round(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5 FROM h""")
def agg36(spark, d):
    """How often the token is the likeliest, or among the likeliest three and five."""
    own = F.round("probability", 13)
    better = F.size(F.filter("p", lambda x: F.round(x, 13) > own))
    tied = F.size(F.filter(F.slice("p", F.lit(1), F.col("token")), lambda x: F.round(x, 13) == own))
    place = better + tied + 1
    hit = lambda k: F.round(F.avg((place <= k).cast("double")), 6)
    return scored(spark, d, "test").agg(F.count(F.lit(1)).alias("n"), hit(1).alias("top1"), hit(3).alias("top3"), hit(5).alias("top5"))


@C.add("vom04_order")
def vom04(spark, d):
    """The reference's orders on the validation pieces."""
    return V.select_order(part(spark, d, "train"), part(spark, d, "validation"), list(ORDERS), BOS, SLICE)


@C.add("nn04_generated")
def nn04(spark, d):
    """Heads of test pieces continued by four tokens each."""
    test = records(spark, d).where("split = 'test'").select("piece_id")
    heads = pieces(spark, d).join(test, "piece_id", "left_semi").select("piece_id", F.slice("tokens", 1, 8).alias("tokens"))
    return V.generate(V.fit(part(spark, d, "train"), DEPTH, BOS), heads, 4, DEPTH, BOS)


def pitch_sequences(spark, d):
    """The pitch classes of each piece's events in order."""
    by = F.sort_array(F.collect_list(F.struct("t", "pc")))
    return events(spark, d).where("pc is not null").groupBy("piece_id").agg(F.transform(by, lambda x: x["pc"]).alias("tokens"))


HMM_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, y AS (SELECT piece_id, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY t) - 1 AS INTEGER) AS t, pc FROM ev WHERE pc IS NOT NULL),
  y2 AS (SELECT piece_id, t, (1 + pc % 12) / 78.0 AS b0, (1 + (pc + 4) % 12) / 78.0 AS b1, (1 + (pc + 8) % 12) / 78.0 AS b2 FROM y),"""


@C.add("hmm02_forward", HMM_SQL + """ f AS (SELECT piece_id, 0 AS t, b0 / (b0 + b1 + b2) AS a0, b1 / (b0 + b1 + b2) AS a1, b2 / (b0 + b1 + b2) AS a2, ln((b0 + b1 + b2) / 3) AS ll FROM y2 WHERE t = 0
    UNION ALL SELECT piece_id, t, m0 / s, m1 / s, m2 / s, ll + ln(s) FROM (SELECT *, m0 + m1 + m2 AS s FROM (SELECT f.piece_id, y2.t, (0.8 * a0 + 0.1 * a1 + 0.1 * a2) * b0 AS m0, (0.1 * a0 + 0.8 * a1 + 0.1 * a2) * b1 AS m1, (0.1 * a0 + 0.1 * a1 + 0.8 * a2) * b2 AS m2, ll FROM f JOIN y2 ON y2.piece_id = f.piece_id AND y2.t = f.t + 1)))
  SELECT piece_id, CAST(max(t) + 1 AS INTEGER) AS n, round(arg_max(ll, t), 6) AS ll FROM f GROUP BY 1""")
def hmm02(spark, d):
    """Scaled forward likelihood for three states."""
    return HM.log_likelihoods(pitch_sequences(spark, d), HM.example_parameters()).select("piece_id", "n", F.round("ll", 6).alias("ll"))


EIGHT = range(8)
HMM8_SQL = HMM_SQL + f""" y8 AS (SELECT piece_id, t, {", ".join(f"(1 + (pc + {4 * k}) % 12) / 78.0 AS b{k}" for k in EIGHT)} FROM y),
  f AS (SELECT piece_id, 0 AS t, {", ".join(f"b{k} / ({' + '.join(f'b{j}' for j in EIGHT)}) AS a{k}" for k in EIGHT)}, ln(({" + ".join(f"b{k}" for k in EIGHT)}) / 8) AS ll FROM y8 WHERE t = 0
    UNION ALL SELECT piece_id, t, {", ".join(f"m{k} / s" for k in EIGHT)}, ll + ln(s) FROM (SELECT *, {" + ".join(f"m{k}" for k in EIGHT)} AS s FROM (
      SELECT f.piece_id, y8.t, ll, {", ".join(f"(0.2 / 7 + a{k} * (0.8 - 0.2 / 7)) * b{k} AS m{k}" for k in EIGHT)} FROM f JOIN y8 ON y8.piece_id = f.piece_id AND y8.t = f.t + 1)))
  SELECT piece_id, CAST(max(t) + 1 AS INTEGER) AS n, round(arg_max(ll, t), 6) AS ll FROM f GROUP BY 1"""


@C.add("hmm02_forward_any", HMM8_SQL)
def hmm02b(spark, d):
    """The same for any number of states."""
    out = HM.log_likelihoods(pitch_sequences(spark, d), HM.example_parameters(8))
    return out.select("piece_id", "n", F.round("ll", 6).alias("ll"))


VITERBI_SQL = HMM_SQL + """ v AS (SELECT piece_id, 0 AS t, ln(b0 / 3) AS d0, ln(b1 / 3) AS d1, ln(b2 / 3) AS d2, 0 AS k0, 0 AS k1, 0 AS k2 FROM y2 WHERE t = 0
    UNION ALL SELECT v.piece_id, y2.t, greatest(d0 + ln(0.8), d1 + ln(0.1), d2 + ln(0.1)) + ln(b0), greatest(d0 + ln(0.1), d1 + ln(0.8), d2 + ln(0.1)) + ln(b1), greatest(d0 + ln(0.1), d1 + ln(0.1), d2 + ln(0.8)) + ln(b2),
      CASE WHEN d0 + ln(0.8) >= greatest(d1, d2) + ln(0.1) THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END, CASE WHEN d0 + ln(0.1) >= greatest(d1 + ln(0.8), d2 + ln(0.1)) THEN 0 WHEN d1 + ln(0.8) >= d2 + ln(0.1) THEN 1 ELSE 2 END,
      CASE WHEN d0 + ln(0.1) >= greatest(d1 + ln(0.1), d2 + ln(0.8)) THEN 0 WHEN d1 + ln(0.1) >= d2 + ln(0.8) THEN 1 ELSE 2 END FROM v JOIN y2 ON y2.piece_id = v.piece_id AND y2.t = v.t + 1),
  e AS (SELECT piece_id, max(t) AS t FROM v GROUP BY 1),
  b AS (SELECT v.piece_id, v.t, CASE WHEN d0 >= greatest(d1, d2) THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS state FROM v JOIN e USING (piece_id, t)
    UNION ALL SELECT v.piece_id, v.t - 1, CASE b.state WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END FROM b JOIN v ON v.piece_id = b.piece_id AND v.t = b.t WHERE v.t > 0)"""


@C.add("hmm03_viterbi", VITERBI_SQL + " SELECT piece_id, t, state FROM b")
def hmm03(spark, d):
    return HM.viterbi(pitch_sequences(spark, d), HM.example_parameters())


@C.add("hmm03_segments", VITERBI_SQL + """, c AS (SELECT piece_id, t, state, CASE WHEN lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS c FROM b WINDOW w AS (PARTITION BY piece_id ORDER BY t)),
  r AS (SELECT *, sum(c) OVER (PARTITION BY piece_id ORDER BY t) AS run FROM c) SELECT piece_id, state, CAST(min(t) AS INTEGER) AS start, CAST(max(t) + 1 AS INTEGER) AS stop FROM r GROUP BY piece_id, state, run""")
def hmm03b(spark, d):
    """Segments of the decoded states."""
    return S.segments(HM.viterbi(pitch_sequences(spark, d), HM.example_parameters()), "piece_id", "t", "state")


@C.add("hmm05_backward_samples")
def hmm05(spark, d):
    return HM.backward_samples(pitch_sequences(spark, d), HM.example_parameters(), 3).select("piece_id", F.size("states").alias("n"), F.xxhash64("states").alias("path"))


#: As in the reference: states tried, updates at most, tokens a scored slice, and the start symbol beside the twelve pitch classes.
HMM_STATES, HMM_UPDATES, HMM_SLICE, HMM_BOS = (12, 24, 48), 100, 128, 12


def split_sequences(spark, d, split: str):
    """The pitch classes of the pieces of one split."""
    return pitch_sequences(spark, d).join(records(spark, d).where(F.col("split") == split).select("piece_id"), "piece_id", "left_semi")


def hmm_grid(spark, d):
    """``HM.fit_grid`` on the whole train and validation splits."""
    train = HM.begun(split_sequences(spark, d, "train"), HMM_BOS)
    validation = HM.begun_slices(split_sequences(spark, d, "validation"), HMM_BOS, HMM_SLICE)
    return HM.fit_grid(train, validation, HMM_STATES, HMM_BOS + 1, HMM_BOS, HMM_UPDATES, seed=1)


@C.add("hmm07_fit")
def hmm07(spark, d):
    """Baum-Welch for each number of states, kept by validation NLL: train likelihood and validation NLL of each update."""
    best, _, log = hmm_grid(spark, d)
    rows = [(k, i + 1, round(ll, 3), round(nll, 6), k == best) for k, (_, history) in log.items() for i, (ll, nll) in enumerate(history)]
    return spark.createDataFrame(rows, "states int, iteration int, log_likelihood double, validation_nll double, selected boolean")


@C.add("hmm09_evaluation")
def hmm09(spark, d):
    """The selected model on each test piece."""
    best, p, _ = hmm_grid(spark, d)
    scores = HM.conditional_scores(HM.begun_slices(split_sequences(spark, d, "test"), HMM_BOS, HMM_SLICE), p, HMM_BOS)
    nll = -F.col("ll") / F.col("n")
    return scores.select("piece_id", F.lit(best).alias("states"), "n", F.round("ll", 6).alias("ll"), F.round(nll, 6).alias("nll"), F.round(F.exp(nll), 6).alias("perplexity"))


@C.add("hmm08_conditional", HMM_SQL.replace("% 12) / 78.0", "% 13) / 91.0") + """
  s AS (SELECT piece_id || '#' || CAST(t // 64 AS VARCHAR) AS s, piece_id, t // 64 AS slice, t % 64 AS u, b0, b1, b2 FROM y2),
  f AS (SELECT s, piece_id, slice, -1 AS u, 13 / 25.0::DOUBLE AS a0, 4 / 25.0::DOUBLE AS a1, 8 / 25.0::DOUBLE AS a2, 0.0::DOUBLE AS ll FROM s WHERE u = 0
    UNION ALL SELECT s, piece_id, slice, u, m0 / z, m1 / z, m2 / z, ll + ln(z) FROM (SELECT *, m0 + m1 + m2 AS z FROM (SELECT f.s, f.piece_id, f.slice, s.u, (0.8 * a0 + 0.1 * a1 + 0.1 * a2) * b0 AS m0, (0.1 * a0 + 0.8 * a1 + 0.1 * a2) * b1 AS m1, (0.1 * a0 + 0.1 * a1 + 0.8 * a2) * b2 AS m2, ll FROM f JOIN s ON s.s = f.s AND s.u = f.u + 1)))
  SELECT piece_id, CAST(slice AS INTEGER) AS slice, CAST(max(u) + 1 AS INTEGER) AS n, round(arg_max(ll, u), 6) AS ll FROM f GROUP BY 1, 2""")
def hmm08(spark, d):
    """Likelihood of each slice of 64 given the start symbol before it: that of both less that of the symbol alone."""
    p = HM.example_parameters(3, HMM_BOS + 1)
    known = float(np.log((p.initial * p.emission[:, HMM_BOS]).sum()))
    rows = pitch_sequences(spark, d).where(F.size("tokens") > 0).withColumn("slice", F.explode(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / 64).cast("int"))))
    cut = rows.select("piece_id", "slice", F.concat(F.array(F.lit(HMM_BOS)), F.slice("tokens", F.col("slice") * 64 + 1, F.lit(64))).alias("tokens"))
    return HM.log_likelihoods(cut, p, "slice").select("piece_id", "slice", (F.col("n") - 1).alias("n"), F.round(F.col("ll") - known, 6).alias("ll"))


#: As in the reference: (alpha, alpha of first states, gamma) tried, truncation, sweeps, burn-in.
HDP_GRID, HDP_STATES, HDP_SWEEPS, HDP_BURN_IN = ((8.0, 4.0, 2.0), (8.0, 8.0, 2.0), (12.0, 4.0, 2.0)), 24, 120, 60


def hdp_grid(spark, d):
    """``HM.gibbs_grid`` on the whole train and validation splits."""
    train = HM.begun(split_sequences(spark, d, "train"), HMM_BOS)
    validation = HM.begun_slices(split_sequences(spark, d, "validation"), HMM_BOS, HMM_SLICE)
    return HM.gibbs_grid(train, validation, HDP_GRID, HDP_STATES, HMM_BOS + 1, HMM_BOS, HDP_SWEEPS, HDP_BURN_IN, seed=2)


@C.add("hdp01_gibbs")
def hdp01(spark, d):
    """Trace of the chains of the HDP-HMM on the train pieces, and which of them validation selects."""
    best, _, chains = hdp_grid(spark, d)
    rows = [(i, t["iteration"], t["log_likelihood"], t["active_states"], t["beta_entropy"], nll, i == best) for i, (nll, trace) in enumerate(chains) for t in trace]
    return spark.createDataFrame(rows, "candidate int, iteration int, log_likelihood double, active_states int, beta_entropy double, validation_nll double, selected boolean")


@C.add("hdp04_state_interpretation")
def hdp04(spark, d):
    """States of a decoded model: occupation, commonest pitch classes, likeliest chord."""
    z = HM.viterbi(pitch_sequences(spark, d), HM.example_parameters())
    y = events(spark, d).select("piece_id", "t", "pc")
    counts = z.join(y, ["piece_id", "t"]).groupBy("state", "pc").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("state")
    top = counts.withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), "pc"))).withColumn("total", F.sum("n").over(by)).where("place <= 4")
    rows = top.groupBy("state").agg(F.max("total").alias("occupation"), F.sort_array(F.collect_list("pc")).alias("pcs"))
    marked = H.with_bits(rows, "pcs")
    chord = H.chord_candidates(marked, 1).select("bits", F.col("label").alias("chord"))
    mode = H.mode_candidates(marked, 1).select("bits", F.col("label").alias("mode"))
    return marked.join(chord, "bits").join(mode, "bits").select("state", "occupation", F.array_join(F.col("pcs").cast("array<string>"), " ").alias("pitch_classes"), "chord", "mode")


CHORD_VALUES = ", ".join(f"({i}, '{s}', '{level}', {list(iv)})" for i, (s, level, iv) in enumerate(H.CHORDS))
MODE_VALUES = ", ".join(f"({i}, '{m}', {list(scale)})" for i, (m, scale) in enumerate(H.MODES.items()))
NAME_LIST = str(H.NAMES)
HAR_SQL = f"""WITH tpl AS (SELECT * FROM (VALUES {CHORD_VALUES}) t(i, symbol, level, iv)), mod AS (SELECT * FROM (VALUES {MODE_VALUES}) m(i, mode, scale)),
  st AS (SELECT CAST(r * 21 + i AS INTEGER) AS state, {NAME_LIST}[r + 1] || ':' || symbol AS label, CAST(r AS INTEGER) AS root, symbol, level, iv, list_sort(list_transform(iv, lambda x: (x + r) % 12)) AS tones FROM range(12) q(r) CROSS JOIN tpl),
  ctx AS (SELECT CAST(r * 7 + i AS INTEGER) AS context, {NAME_LIST}[r + 1] || ':' || mode AS label, CAST(r AS INTEGER) AS tonic, mode, list_sort(list_transform(scale, lambda x: (x + r) % 12)) AS tones FROM range(12) q(r) CROSS JOIN mod),
  sup AS (SELECT s.state, list_distinct(flatten(list(list_transform(m.scale, lambda x: (x + s.root) % 12)))) AS modal FROM st s JOIN mod m ON len(list_filter(s.iv, lambda x: NOT list_contains(m.scale, x))) = 0 GROUP BY 1),
  em0 AS (SELECT st.state, CAST(pc AS INTEGER) AS pc, tones, list_filter(coalesce(modal, []), lambda x: NOT list_contains(tones, x)) AS extra FROM st LEFT JOIN sup USING (state) CROSS JOIN range(12) p(pc)),
  em1 AS (SELECT state, pc, CASE WHEN list_contains(tones, pc) THEN 0.72 / len(tones) WHEN list_contains(extra, pc) THEN 0.20 / len(extra) ELSE (0.08 + CASE WHEN len(extra) = 0 THEN 0.20 ELSE 0 END) / (12 - len(tones) - len(extra)) END AS p FROM em0),
  em AS (SELECT state, pc, p / sum(p) OVER (PARTITION BY state) AS p FROM em1)"""


@C.add("har01_states", HAR_SQL + " SELECT state, label, root, symbol, level, array_to_string(tones, ' ') AS tones FROM st")
def har01(spark, d):
    return H.chord_states(spark).select("state", "label", "root", "symbol", "level", F.array_join(F.col("tones").cast("array<string>"), " ").alias("tones"))


@C.add("har02_modal_contexts", HAR_SQL + " SELECT context, label, tonic, mode, array_to_string(tones, ' ') AS tones FROM ctx")
def har02(spark, d):
    return H.modal_contexts(spark).select("context", "label", "tonic", "mode", F.array_join(F.col("tones").cast("array<string>"), " ").alias("tones"))


@C.add("har03_emissions", HAR_SQL + " SELECT state, pc, round(p, 6) AS p FROM em")
def har03(spark, d):
    return H.emissions(spark).select("state", "pc", F.round("p", 6).alias("p"))


SETS_SQL = HAR_SQL + f""", {EVENTS_SQL}, ms AS (SELECT piece_id, measure, CAST(sum(DISTINCT (1 << (pc % 12))) AS INTEGER) AS bits FROM ev WHERE measure IS NOT NULL AND pc IS NOT NULL GROUP BY 1, 2),
  pr AS (SELECT bits, CAST(pc AS INTEGER) AS pc, 1.0 / bit_count(bits) AS w FROM (SELECT DISTINCT bits FROM ms) CROSS JOIN range(12) p(pc) WHERE (bits >> pc) & 1 = 1)"""


def measure_sets(spark, d):
    """The set of pitch classes of every measure of every piece."""
    bit = F.pow(F.lit(2), F.pmod("pc", F.lit(12))).cast("int")
    return events(spark, d).where("measure is not null and pc is not null").groupBy("piece_id", "measure").agg(F.bit_or(bit).alias("bits"))


@C.add("har05_chords", SETS_SQL + """, sc AS (SELECT bits, state, round(sum(w * ln(p + 1e-12)), 9) AS score FROM pr JOIN em USING (pc) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY bits ORDER BY score DESC, state) AS place FROM sc)
  SELECT piece_id, measure, label AS chord FROM ms JOIN b USING (bits) JOIN st USING (state) WHERE place = 1""")
def har05(spark, d):
    """The chord of every measure; scores are made for each distinct set only."""
    sets = measure_sets(spark, d)
    best = F.broadcast(H.chord_candidates(sets, 1))  # at most 4 096 sets
    return sets.join(best, "bits").select("piece_id", "measure", F.col("label").alias("chord"))


@C.add("har06_modes", SETS_SQL + """, sc AS (SELECT bits, context, round(sum(CASE WHEN list_contains(tones, pc) THEN w ELSE 0 END) - 0.6 * (1 - sum(CASE WHEN list_contains(tones, pc) THEN w ELSE 0 END)), 9) AS score FROM pr CROSS JOIN ctx GROUP BY 1, 2),
  b AS (SELECT *, row_number() OVER (PARTITION BY bits ORDER BY score DESC, context) AS place FROM sc) SELECT bits, CAST(place AS INTEGER) AS place, label, round(score, 6) AS score FROM b JOIN ctx USING (context) WHERE place <= 3""")
def har06(spark, d):
    """The three best modes of every distinct set that occurs."""
    return H.mode_candidates(measure_sets(spark, d), 3).select("bits", "place", "label", F.round("score", 6).alias("score"))


@C.add("win03_local_modes", HAR_SQL + f""", {EVENTS_SQL}, w AS (SELECT piece_id, t, pc, list(pc % 12) OVER (PARTITION BY piece_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f FROM ev WHERE pc IS NOT NULL),
  z AS (SELECT piece_id, t, CAST(list_sum(list_transform(list_distinct(f), lambda x: 1 << x)) AS INTEGER) AS bits FROM w), ds AS (SELECT DISTINCT bits FROM z),
  pr AS (SELECT bits, CAST(pc AS INTEGER) AS pc, 1.0 / bit_count(bits) AS w FROM ds CROSS JOIN range(12) p(pc) WHERE (bits >> pc) & 1 = 1),
  sc AS (SELECT bits, context, round(sum(CASE WHEN list_contains(tones, pc) THEN w ELSE 0 END) - 0.6 * (1 - sum(CASE WHEN list_contains(tones, pc) THEN w ELSE 0 END)), 9) AS score FROM pr CROSS JOIN ctx GROUP BY 1, 2),
  b AS (SELECT bits, arg_min(context, struct_pack(s := -score, c := context)) AS context FROM sc GROUP BY 1) SELECT piece_id, t, label AS mode FROM z JOIN b USING (bits) JOIN ctx USING (context)""")
def win03(spark, d):
    """The mode around each event: two events either side."""
    frame = Window.partitionBy("piece_id").orderBy("t").rowsBetween(-2, 2)
    rows = H.with_bits(events(spark, d).where("pc is not null").select("piece_id", "t", F.collect_list("pc").over(frame).alias("f")), "f")
    best = F.broadcast(H.mode_candidates(rows, 1))  # at most 4 096 sets
    return rows.join(best, "bits").select("piece_id", "t", F.col("label").alias("mode"))


@C.add("hmm01_transitions", HAR_SQL + """, cm AS (SELECT s.state, list(m.mode) AS modes FROM st s JOIN mod m ON len(list_filter(s.iv, lambda x: NOT list_contains(m.scale, x))) = 0 GROUP BY 1), q AS (SELECT st.*, coalesce(modes, []) AS modes FROM st LEFT JOIN cm USING (state)),
  w AS (SELECT a.state AS i, b.state AS j, 1.0 + CASE WHEN a.state = b.state THEN 2.5 ELSE 0 END + CASE WHEN a.root = b.root THEN 0.8 + CASE WHEN a.level = b.level THEN 0.3 ELSE 0 END ELSE 0 END + CASE WHEN (b.root - a.root + 12) % 12 IN (5, 7) THEN 0.4 ELSE 0 END
    + CASE WHEN list_has_any(a.modes, b.modes) THEN 0.3 ELSE 0 END AS w FROM q a CROSS JOIN q b) SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 9) AS p FROM w""")
def hmm01(spark, d):
    return H.transition_scores(spark).select("i", "j", F.round("p", 9).alias("p"))


BOUNDARY_SQL = f"WITH {EVENTS_SQL}, " + """ m AS (SELECT piece_id, t, measure <> lag(measure) OVER w AS mb, pc IS DISTINCT FROM lag(pc) OVER w AND lag(t) OVER w IS NOT NULL AS pb FROM ev WHERE measure IS NOT NULL WINDOW w AS (PARTITION BY piece_id ORDER BY t)),
  c AS (SELECT piece_id, sum(CASE WHEN mb THEN 1 ELSE 0 END) AS r, sum(CASE WHEN pb THEN 1 ELSE 0 END) AS p, sum(CASE WHEN mb AND pb THEN 1 ELSE 0 END) AS n FROM m GROUP BY 1),
  s AS (SELECT piece_id, CAST(n AS INTEGER) AS n_match, CASE WHEN p = 0 THEN 1.0 ELSE n / p END AS precision, CASE WHEN r = 0 THEN 1.0 ELSE n / r END AS recall FROM c)"""


@C.add("jon09_boundary_f1", BOUNDARY_SQL + " SELECT piece_id, n_match, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM s")
def jon09(spark, d):
    """Changes of pitch class held against changes of measure, at tolerance 0."""
    return boundary_scores(boundaries(spark, d), "piece_id", "reference", "predicted")


@C.add("sta05_boundary_f1_tolerant")
def sta05(spark, d):
    """The same within one event, matched one to one."""
    return boundary_scores(boundaries(spark, d), "piece_id", "reference", "predicted", 1)


def boundaries(spark, d):
    by = Window.partitionBy("piece_id").orderBy("t")
    rows = events(spark, d).where("measure is not null").select(
        "piece_id", "t", (F.col("measure") != F.lag("measure").over(by)).alias("r"), (~F.col("pc").eqNullSafe(F.lag("pc").over(by)) & F.lag("t").over(by).isNotNull()).alias("p")
    )
    return rows.groupBy("piece_id").agg(F.collect_list(F.when(F.col("r"), F.col("t"))).alias("reference"), F.collect_list(F.when(F.col("p"), F.col("t"))).alias("predicted"))
