"""The base relations of the engine, cleaned: events, tokens, pieces, records in force, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.sources.tables import table

#: The same relations in SQL, as common table expressions.
EVENTS_SQL = """ev AS (
  SELECT piece_id, index AS t, "offset", duration, kind, label, pitch_classes, midi_pitches,
         representative_pitch_class AS pc, representative_midi AS midi, measure, beat
  FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, index ORDER BY extracted_at DESC) AS rn
        FROM musical_events WHERE piece_id IS NOT NULL AND index IS NOT NULL) WHERE rn = 1)"""
PIECES_SQL = """pieces AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY prepared_at DESC) AS rn
    FROM prepared_pieces WHERE piece_id IS NOT NULL AND tokens IS NOT NULL) WHERE rn = 1)"""
TOKENS_SQL = PIECES_SQL + """,
tok AS (SELECT piece_id, CAST(i - 1 AS INTEGER) AS t, tokens[i] AS token
        FROM (SELECT piece_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM pieces))"""
RECORDS_SQL = """records AS (
  SELECT * EXCLUDE (rn, split), CASE WHEN lower(trim(split)) IN ('val', 'valid') THEN 'validation'
                          WHEN trim(split) <> '' THEN lower(trim(split)) END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY registered_at DESC NULLS LAST, lower(trim(split)) DESC NULLS LAST) AS rn
        FROM score_records WHERE piece_id IS NOT NULL) WHERE rn = 1)"""
METRICS_SQL = """metrics AS (
  SELECT DISTINCT piece_id, nullif(lower(trim(regexp_replace(canonical_work_id, '[\\s_.\\-]+', ' ', 'g'))), '') AS work,
         model, frac, data_seed, model_seed, split_seed, CASE WHEN isnan(nll_per_token) THEN NULL ELSE nll_per_token END AS nll, n_tokens
  FROM piece_metrics)"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    """``musical_events`` with one row per event, the latest extraction of each."""
    rows = table(spark, folder, "musical_events").where("piece_id is not null and index is not null")
    latest = Window.partitionBy("piece_id", "index").orderBy(F.desc("extracted_at"))
    # partitioned by piece once: the windows of every operator reuse it
    return (
        rows.select(
            "piece_id", "index", "offset", "duration", "kind", "label", "pitch_classes", "midi_pitches",
            "representative_pitch_class", "representative_midi", "measure", "beat", "extracted_at",
        )
        .repartition("piece_id")
        .withColumn("rn", F.row_number().over(latest))
        .where("rn = 1")
        .select(
            "piece_id", F.col("index").alias("t"), "offset", "duration", "kind", "label", "pitch_classes", "midi_pitches",
            F.col("representative_pitch_class").alias("pc"), F.col("representative_midi").alias("midi"), "measure", "beat",
        )
    )


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """``prepared_pieces`` with one row per piece, the latest delivery of each."""
    rows = table(spark, folder, "prepared_pieces").where("piece_id is not null and tokens is not null")
    latest = Window.partitionBy("piece_id").orderBy(F.desc("prepared_at"))
    return rows.withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn")


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``(piece_id, t, token)``: the tokens of every piece in long form."""
    return pieces(spark, folder).select("piece_id", F.posexplode("tokens").alias("t", "token"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``score_records`` with the row in force of each piece and its split written one way."""
    plain = F.lower(F.trim("split"))
    latest = Window.partitionBy("piece_id").orderBy(F.desc_nulls_last("registered_at"), F.desc_nulls_last(plain))
    return (
        table(spark, folder, "score_records").where("piece_id is not null")
        .withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn")
        .withColumn("split", F.when(plain.isin("val", "valid"), "validation").when(plain != "", plain))
    )


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """``piece_metrics`` without repeated rows; NaN scores are null and work ids are written one way."""
    work = F.trim(F.lower(F.regexp_replace("canonical_work_id", r"[\s_.\-]+", " ")))
    return (
        table(spark, folder, "piece_metrics")
        .select(
            "piece_id", F.when(work != "", work).alias("work"), "model", "frac", "data_seed", "model_seed", "split_seed",
            F.when(~F.isnan("nll_per_token"), F.col("nll_per_token")).alias("nll"), "n_tokens",
        )
        .distinct()
    )
