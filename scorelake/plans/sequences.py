"""Queries on events and tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.operators import sequences as S
from scorelake.plans.common import Catalogue
from scorelake.sources.relations import EVENTS_SQL, PIECES_SQL, RECORDS_SQL, TOKENS_SQL, events, pieces, records, tokens
from scorelake.sources.tables import table

C = Catalogue()

#: Duration bins in quarter lengths, metrical classes.
BINS = [0.25, 0.5, 1.0, 2.0, 4.0]
LEVELS = ["downbeat", "beat", "offbeat", "subbeat", "unknown"]
N_SYMBOLS, BOS = 60, 60
EV = f"WITH {EVENTS_SQL} "
TOK = f"WITH {TOKENS_SQL} "
NEAREST_SQL = """CASE least(abs(duration - 0.25), abs(duration - 0.5), abs(duration - 1), abs(duration - 2), abs(duration - 4))
  WHEN abs(duration - 0.25) THEN 0 WHEN abs(duration - 0.5) THEN 1 WHEN abs(duration - 1) THEN 2 WHEN abs(duration - 2) THEN 3 ELSE 4 END"""
LEVEL_SQL = """CASE WHEN beat IS NULL THEN 'unknown' WHEN abs(beat - 1) <= 1e-3 THEN 'downbeat' WHEN abs(beat - round_even(beat, 0)) <= 1e-3 THEN 'beat'
  WHEN abs(beat * 2 - round_even(beat * 2, 0)) <= 1e-3 THEN 'offbeat' ELSE 'subbeat' END"""


@C.add("win01_intervals", EV + """, d AS (SELECT piece_id, t, midi - lag(midi) OVER (PARTITION BY piece_id ORDER BY t) AS step FROM ev), e AS (SELECT piece_id, t, CASE WHEN step IS NOT NULL THEN greatest(least(step, 12), -12) END AS interval FROM d)
  SELECT piece_id, t, interval, CAST(coalesce(interval + 13, 0) AS INTEGER) AS token FROM e""")
def win01(spark, d):
    return S.intervals(events(spark, d), "piece_id", "t", "midi").select("piece_id", "t", "interval", "token")


SEG = EV + """, f AS (SELECT piece_id, t, pc, CASE WHEN pc IS NOT DISTINCT FROM lag(pc) OVER w AND lag(t) OVER w IS NOT NULL THEN 0 ELSE 1 END AS c
    FROM ev WINDOW w AS (PARTITION BY piece_id ORDER BY t)),
  r AS (SELECT *, sum(c) OVER (PARTITION BY piece_id ORDER BY t) AS run FROM f),
  seg AS (SELECT piece_id, any_value(pc) AS state, min(t) AS start, max(t) + 1 AS stop FROM r GROUP BY piece_id, run)"""


@C.add("win02_segments", SEG + " SELECT piece_id, state, start, stop FROM seg")
def win02(spark, d):
    return S.segments(events(spark, d), "piece_id", "t", "pc")


@C.add("agg26_segment_statistics", SEG + " SELECT piece_id, count(*) AS n_segments, round(avg(stop - start), 6) AS mean_length, round(median(stop - start), 6) AS median_length FROM seg GROUP BY 1")
def agg26(spark, d):
    return S.segment_statistics(events(spark, d), "piece_id", "t", "pc")


@C.add("agg41_dwell_times", SEG + " SELECT state, count(*) AS n_visits, round(avg(stop - start), 6) AS mean_dwell, round(median(stop - start), 6) AS median_dwell, max(stop - start) AS longest FROM seg GROUP BY 1")
def agg41(spark, d):
    return S.dwell_times(events(spark, d), "piece_id", "t", "pc")


@C.add("win04_reindex", EV + """SELECT piece_id, t, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY "offset", t) - 1 AS INTEGER) AS position FROM ev""")
def win04(spark, d):
    """Events in order of time, numbered anew from 0."""
    by = Window.partitionBy("piece_id").orderBy("offset", "t")
    return events(spark, d).select("piece_id", "t", (F.row_number().over(by) - 1).alias("position"))


WINDOWS = f"WITH {PIECES_SQL}, n AS (SELECT piece_id, len(tokens) AS n FROM pieces), starts AS (SELECT piece_id, n, unnest(range(0, n, {{s}})) AS start FROM n) "


@C.add("win05_train_windows", WINDOWS.format(s=64) + """SELECT piece_id, CAST(start AS INTEGER) AS start, CAST(least(start + 128, n) AS INTEGER) AS stop FROM starts
  WHERE (start = 0 OR start - 64 + 128 < n) AND least(start + 128, n) - start >= 32""")
def win05(spark, d):
    return S.train_windows(pieces(spark, d).select("piece_id", F.size("tokens").alias("n"))).select("piece_id", "start", "stop")


@C.add("win06_eval_slices", WINDOWS.format(s=128) + "SELECT piece_id, CAST(start AS INTEGER) AS start, CAST(least(start + 128, n) AS INTEGER) AS stop FROM starts")
def win06(spark, d):
    return S.eval_slices(pieces(spark, d).select("piece_id", F.size("tokens").alias("n"))).select("piece_id", "start", "stop")


@C.add("agg13_exposure", WINDOWS.format(s=64) + """, w AS (SELECT piece_id, start, least(start + 128, n) AS stop FROM starts WHERE (start = 0 OR start - 64 + 128 < n) AND least(start + 128, n) - start >= 32),
  seen AS (SELECT piece_id, unnest(range(start, stop)) AS t FROM w), c AS (SELECT count(*) AS times FROM seen GROUP BY piece_id, t)
  SELECT times, count(*) AS n_events FROM c GROUP BY times""")
def agg13(spark, d):
    return S.exposure(pieces(spark, d).select("piece_id", F.size("tokens").alias("n")), "piece_id")


@C.add("dq06_training_exposure", WINDOWS.format(s=64) + """, w AS (SELECT piece_id, start, least(start + 128, n) AS stop FROM starts WHERE (start = 0 OR start - 64 + 128 < n) AND least(start + 128, n) - start >= 32),
  seen AS (SELECT piece_id, unnest(range(start, stop)) AS t FROM w), c AS (SELECT count(*) AS times FROM seen GROUP BY piece_id, t)
  SELECT count(*) AS n_events, round(avg(times), 6) AS mean_exposure, max(times) AS max_exposure, max(times) <= 1 AS non_overlapping FROM c""")
def dq06(spark, d):
    """Audit of how often training sees an event."""
    hist = S.exposure(pieces(spark, d).select("piece_id", F.size("tokens").alias("n")), "piece_id")
    return hist.agg(
        F.sum("n_events").alias("n_events"), F.round(F.sum(F.col("times") * F.col("n_events")) / F.sum("n_events"), 6).alias("mean_exposure"),
        F.max("times").alias("max_exposure"), (F.max("times") <= 1).alias("non_overlapping"),
    )


@C.add("win07_slice_context", TOK + """SELECT piece_id, t, CAST(t // 32 AS INTEGER) AS slice,
  CASE WHEN t % 32 = 0 THEN '60' WHEN t % 32 = 1 THEN '60,' || lag(token, 1) OVER w ELSE lag(token, 2) OVER w || ',' || lag(token, 1) OVER w END AS context, token
  FROM tok WINDOW w AS (PARTITION BY piece_id ORDER BY t)""")
def win07(spark, d):
    """Context of depth two, started anew with BOS in every slice of 32."""
    return S.slice_context(tokens(spark, d), "piece_id", "t", "token", 32, 2, BOS).select(
        "piece_id", "t", "slice", F.array_join("context", ",").alias("context"), "token"
    )


@C.add("win08_bos_shift", TOK + "SELECT piece_id, t, coalesce(lag(token) OVER (PARTITION BY piece_id ORDER BY t), 60) AS input, token AS target FROM tok")
def win08(spark, d):
    return S.bos_shift(tokens(spark, d), "piece_id", "t", "token", BOS).select("piece_id", "t", "input", "target")


@C.add("agg07_transitions", EV + """, p AS (SELECT pc AS i, lead(pc) OVER (PARTITION BY piece_id ORDER BY t) AS j FROM ev), n AS (SELECT i, j, count(*) AS n FROM p WHERE i IS NOT NULL AND j IS NOT NULL GROUP BY ALL)
  SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, coalesce(n, 0) AS n FROM range(12) a(i) CROSS JOIN range(12) b(j) LEFT JOIN n ON n.i = a.i AND n.j = b.j""")
def agg07(spark, d):
    return S.transitions(events(spark, d), "piece_id", "t", "pc", 12)


@C.add("agg08_token_transitions", TOK + ", p AS (SELECT token AS i, lead(token) OVER (PARTITION BY piece_id ORDER BY t) AS j FROM tok) SELECT i, j, count(*) AS n FROM p WHERE i IS NOT NULL AND j IS NOT NULL GROUP BY ALL")
def agg08(spark, d):
    return S.transitions(tokens(spark, d), "piece_id", "t", "token")


@C.add("prj16_transition_edges", EV + """, p AS (SELECT pc AS src, lead(pc) OVER (PARTITION BY piece_id ORDER BY t) AS dst FROM ev), n AS (SELECT src, dst, count(*) AS n FROM p WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL)
  SELECT * FROM (SELECT src, dst, round(n / sum(n) OVER (PARTITION BY src), 6) AS weight FROM n) WHERE weight >= 0.05""")
def prj16(spark, d):
    """Edges of the transition graph of at least a twentieth."""
    counts = S.transitions(events(spark, d), "piece_id", "t", "pc")
    weight = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("i")), 6)
    return counts.select(F.col("i").alias("src"), F.col("j").alias("dst"), weight.alias("weight")).where("weight >= 0.05")


@C.add("agg09_emissions", f"WITH {EVENTS_SQL}, {TOKENS_SQL} SELECT pc AS state, token, count(*) AS n FROM ev JOIN tok USING (piece_id, t) GROUP BY ALL")
def agg09(spark, d):
    """Counts of symbol by state: pitch class of the event by token of the piece.

    Spark sizes token arrays by their files and would broadcast them, many times that in memory.
    """
    arrays = pieces(spark, d).select("piece_id", "tokens").hint("merge")
    return (
        events(spark, d).select("piece_id", "t", F.col("pc").alias("state")).join(arrays, "piece_id")
        .where((F.col("t") >= 0) & (F.col("t") < F.size("tokens")))
        .groupBy("state", F.get("tokens", F.col("t")).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    )


NGRAMS = TOK + """, l AS (SELECT token, t AS p, lag(token, 1) OVER w AS l1, lag(token, 2) OVER w AS l2 FROM tok WINDOW w AS (PARTITION BY piece_id ORDER BY t)),
  c AS (SELECT 0 AS k, '' AS context, token FROM l UNION ALL SELECT 1, CAST(coalesce(l1, 60) AS VARCHAR), token FROM l
    UNION ALL SELECT 2, CASE WHEN p = 1 THEN '60' ELSE CAST(l2 AS VARCHAR) END || ',' || l1, token FROM l WHERE p >= 1),
  grams AS (SELECT k, context, token, count(*) AS n FROM c GROUP BY ALL)"""


@C.add("agg10_ngrams", NGRAMS + " SELECT k, context, token, n FROM grams")
def agg10(spark, d):
    return S.ngram_counts(tokens(spark, d), "piece_id", "t", "token", 2, BOS)


@C.add("agg11_count_cells", NGRAMS + " SELECT k, count(*) AS cells, CAST(sum(n) AS BIGINT) AS total FROM grams GROUP BY k")
def agg11(spark, d):
    """Size of the model: non-zero cells of each order."""
    return S.ngram_counts(tokens(spark, d), "piece_id", "t", "token", 2, BOS).groupBy("k").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("total"))


@C.add("mth11_dense_vocabulary", EV + "SELECT piece_id, t, midi, CAST(dense_rank() OVER (PARTITION BY piece_id ORDER BY midi) - 1 AS INTEGER) AS id FROM ev")
def mth11(spark, d):
    return S.dense_ids(events(spark, d), "piece_id", "midi").select("piece_id", "t", "midi", "id")


@C.add("tok02_pitch_duration_pairs", EV + """SELECT piece_id, t, CAST(dense_rank() OVER (PARTITION BY piece_id ORDER BY pc, duration) - 1 AS INTEGER) AS id FROM ev""")
def tok02(spark, d):
    """Pairs of pitch class and duration as dense tokens of each piece."""
    return S.dense_ids(events(spark, d), "piece_id", "pc", "duration").select("piece_id", "t", "id")


@C.add("jon10_nearest_bin", EV + f"SELECT piece_id, t, duration, CAST({NEAREST_SQL} AS INTEGER) AS bin FROM ev")
def jon10(spark, d):
    return events(spark, d).select("piece_id", "t", "duration", S.nearest_bin(F.col("duration"), BINS).alias("bin"))


@C.add("mth08_metrical_classes", EV + f", c AS (SELECT {LEVEL_SQL} AS level FROM ev) SELECT level, count(*) AS n FROM c GROUP BY 1")
def mth08(spark, d):
    return events(spark, d).select(S.metrical_class(F.col("beat")).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@C.add("tok01_tokens", EV + f""", c AS (SELECT piece_id, t, pc, {NEAREST_SQL} AS b, {LEVEL_SQL} AS level FROM ev)
  SELECT piece_id, t, CAST(pc * 5 + b AS INTEGER) AS pitch_duration,
    CAST(coalesce(pc, 12) * 25 + b * 5 + list_position(['downbeat', 'beat', 'offbeat', 'subbeat', 'unknown'], level) - 1 AS INTEGER) AS pitch_duration_metrical FROM c""")
def tok01(spark, d):
    """Mixed-radix tokens: pitch class by duration bin, and by metrical class."""
    level = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), S.metrical_class(F.col("beat"))) - 1
    b = S.nearest_bin(F.col("duration"), BINS)
    return events(spark, d).select(
        "piece_id", "t", (F.col("pc") * 5 + b).cast("int").alias("pitch_duration"),
        (F.coalesce("pc", F.lit(12)) * 25 + b * 5 + level).cast("int").alias("pitch_duration_metrical"),
    )


@C.add("tok03_vocabulary", """SELECT CAST(p * 5 + b AS INTEGER) AS id, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][p + 1] || '|dur=' || ['0.25', '0.5', '1', '2', '4'][b + 1] AS label
  FROM range(12) x(p) CROSS JOIN range(5) y(b) UNION ALL SELECT 60, 'BOS' UNION ALL SELECT 61, 'PAD'""")
def tok03(spark, d):
    """The vocabulary of pitch class and duration with its special symbols."""
    names = F.array(*[F.lit(x) for x in "C C# D D# E F F# G G# A A# B".split()])
    bins = F.array(*[F.lit(f"{x:g}") for x in BINS])
    rows = spark.range(60).select(
        F.col("id").cast("int").alias("id"),
        F.concat(F.element_at(names, (F.floor(F.col("id") / 5) + 1).cast("int")), F.lit("|dur="), F.element_at(bins, (F.pmod("id", F.lit(5)) + 1).cast("int"))).alias("label"),
    )
    return rows.union(spark.createDataFrame([(60, "BOS"), (61, "PAD")], "id int, label string"))


@C.add("mth12_decode", TOK + ", c AS (SELECT token, count(*) AS n FROM tok GROUP BY 1) SELECT c.token, v.label, n, v.label IS NOT NULL AS in_range FROM c LEFT JOIN token_vocabulary v ON v.token = c.token")
def mth12(spark, d):
    """Tokens with their labels; a token out of range has none."""
    vocabulary = F.broadcast(table(spark, d, "token_vocabulary"))  # fixed, 60 rows
    counts = tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(vocabulary, "token", "left").select("token", "label", "n", F.col("label").isNotNull().alias("in_range"))


@C.add("win17_fingerprints", f"""WITH {PIECES_SQL}, l AS (SELECT piece_id, tokens[1:33] AS h FROM pieces)
  SELECT piece_id, CASE WHEN len(h) >= 2 THEN substr(sha256(array_to_string(list_transform(range(2, len(h) + 1), lambda i: CAST(h[i] - h[i - 1] AS VARCHAR)), ',')), 1, 16) END AS fingerprint FROM l""")
def win17(spark, d):
    return pieces(spark, d).select("piece_id", S.fingerprint(F.col("tokens")).alias("fingerprint"))


@C.add("agg25_stability", EV + ", c AS (SELECT t, pc, count(*) AS n FROM ev GROUP BY ALL), s AS (SELECT t, max(n) / sum(n) AS share FROM c GROUP BY t) SELECT count(*) AS n_positions, round(avg(share), 6) AS stability FROM s")
def agg25(spark, d):
    return S.stability(events(spark, d), "t", "pc")


@C.add("arr01_padded", f"WITH {PIECES_SQL} SELECT piece_id, array_to_string(list_resize(tokens[1:48], 48, 61), ',') AS padded, CAST(least(len(tokens), 48) AS INTEGER) AS n_real FROM pieces")
def arr01(spark, d):
    out = S.padded(pieces(spark, d), "piece_id", "tokens", 48, 61)
    return out.withColumn("padded", F.array_join("padded", ","))


BINCOUNT = ", ".join(f"CAST(sum(CASE WHEN token // 5 = {k} THEN 1 ELSE 0 END) AS VARCHAR)" for k in range(12))


@C.add("arr02_bincount", TOK + f"SELECT piece_id, array_to_string([{BINCOUNT}], ',') AS counts FROM tok GROUP BY piece_id")
def arr02(spark, d):
    """Counts of the twelve pitch classes in each piece."""
    classes = F.transform("tokens", lambda x: F.floor(x / 5))
    counts = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.size(F.filter(classes, lambda c: c == k)).cast("string"))
    return pieces(spark, d).where(F.size("tokens") > 0).select("piece_id", F.array_join(counts, ",").alias("counts"))


@C.add("arr03_alignment", TOK + ", x AS (SELECT token, label FROM token_vocabulary) SELECT piece_id, t, token, label FROM tok JOIN x USING (token)")
def arr03(spark, d):
    """Tokens aligned with the labels of the piece's own vocabulary array."""
    return pieces(spark, d).select("piece_id", "vocabulary", F.posexplode("tokens").alias("t", "token")).select(
        "piece_id", "t", "token", F.expr("try_element_at(vocabulary, token + 1)").alias("label")
    )


@C.add("agg22_score_statistics", EV + """SELECT piece_id, CAST(sum(CASE WHEN kind = 'note' THEN 1 ELSE 0 END) AS BIGINT) AS n_notes, CAST(sum(CASE WHEN kind = 'chord' THEN 1 ELSE 0 END) AS BIGINT) AS n_chords,
  count(DISTINCT measure) AS n_measures, max(measure) AS last_measure, count(DISTINCT pc) AS n_pitch_classes,
  round(count(*) / nullif(count(DISTINCT measure), 0), 3) AS events_per_measure, round(max("offset" + duration), 6) AS total_length FROM ev GROUP BY 1""")
def agg22(spark, d):
    """Counts of notes, chords, measures and pitch classes of each piece."""
    return events(spark, d).groupBy("piece_id").agg(
        F.count_if(F.col("kind") == "note").alias("n_notes"), F.count_if(F.col("kind") == "chord").alias("n_chords"),
        F.countDistinct("measure").alias("n_measures"), F.max("measure").alias("last_measure"), F.countDistinct("pc").alias("n_pitch_classes"),
        F.round(F.try_divide(F.count(F.lit(1)), F.nullif(F.countDistinct("measure"), F.lit(0))), 3).alias("events_per_measure"),
        F.round(F.max(F.col("offset") + F.col("duration")), 6).alias("total_length"),
    )


@C.add("prj05_representative_pitch", EV + "SELECT piece_id, t, pc, coalesce(list_min(list_filter(midi_pitches, lambda m: m % 12 = pc)), list_min(midi_pitches)) AS lowest FROM ev")
def prj05(spark, d):
    """Lowest pitch of the event's representative class, else the bass."""
    own = F.array_min(F.filter("midi_pitches", lambda m: F.pmod(m, F.lit(12)) == F.col("pc")))
    return events(spark, d).select("piece_id", "t", "pc", F.coalesce(own, F.array_min("midi_pitches")).alias("lowest"))


@C.add("prj15_min_length", f"""WITH {EVENTS_SQL}, n AS (SELECT piece_id, count(*) AS n_events FROM ev GROUP BY 1)
  SELECT piece_id, n_events, CASE WHEN n_events < 32 THEN 'too_short' ELSE 'prepared' END AS status FROM n""")
def prj15(spark, d):
    """Pieces below the least number of events go to the exclusions."""
    n = events(spark, d).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n_events"))
    return n.withColumn("status", F.when(F.col("n_events") < 32, "too_short").otherwise("prepared"))


@C.add("prj25_prompts", f"""WITH {PIECES_SQL}, {RECORDS_SQL} SELECT piece_id, CAST(least(16, greatest(4, len(tokens) // 2)) AS INTEGER) AS n_prompt,
  array_to_string(tokens[1:least(16, greatest(4, len(tokens) // 2))], ',') AS prompt,
  array_to_string(tokens[least(16, greatest(4, len(tokens) // 2)) + 1:least(16, greatest(4, len(tokens) // 2)) + 8], ',') AS target
  FROM pieces JOIN records USING (piece_id) WHERE split = 'test' AND len(tokens) > least(16, greatest(4, len(tokens) // 2)) ORDER BY piece_id LIMIT 5""")
def prj25(spark, d):
    """Prompts for generation: the first five test pieces by id, a head and its continuation."""
    n = F.least(F.lit(16), F.greatest(F.lit(4), F.floor(F.size("tokens") / 2).cast("int")))
    test = records(spark, d).where("split = 'test'").select("piece_id")
    return (
        pieces(spark, d).join(test, "piece_id", "left_semi").withColumn("n_prompt", n).where(F.size("tokens") > F.col("n_prompt"))
        .orderBy("piece_id").limit(5)
        .select("piece_id", "n_prompt", F.array_join(F.slice("tokens", F.lit(1), F.col("n_prompt")), ",").alias("prompt"),
                F.array_join(F.slice("tokens", F.col("n_prompt") + 1, F.lit(8)), ",").alias("target"))
    )
