"""Queries on sources, sinks and streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scorelake.plans.common import Catalogue
from scorelake.session import scratch_folder
from scorelake.sources import catalogs, musicxml, sinks
from scorelake.sources.relations import EVENTS_SQL, METRICS_SQL, PIECES_SQL, RECORDS_SQL, events, metrics, pieces, records
from scorelake.sources.tables import table
from scorelake.streaming import sequences as ST

C = Catalogue()


def score_documents(spark, d):
    """A MusicXML document of each piece, written from its events."""

    packed = F.sort_array(F.collect_list(F.struct("t", "offset", "duration", "midi_pitches")))  # one piece's events
    return musicxml.write_files(events(spark, d).groupBy("piece_id").agg(packed.alias("events")))


@C.add("udtf01_musicxml", f"""WITH {EVENTS_SQL}, n AS (SELECT piece_id, count(*) AS n FROM ev GROUP BY 1)
  SELECT piece_id, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY round("offset", 4), t) - 1 AS INTEGER) AS index, round("offset", 4) AS "offset", round(duration, 4) AS duration, array_to_string(list_sort(midi_pitches), '.') AS pitches FROM ev JOIN n USING (piece_id) WHERE n >= 32""")
def udtf01(spark, d):
    """Scores of all pieces, written and parsed again."""
    parsed = musicxml.rewritten(events(spark, d))
    return parsed.select("piece_id", "index", F.round("offset", 4).alias("offset"), F.round("duration", 4).alias("duration"), F.array_join(F.col("midi_pitches").cast("array<string>"), ".").alias("pitches"))


@C.add("src03_parse_status", f"""WITH {EVENTS_SQL}, n AS (SELECT piece_id, count(*) AS n FROM ev GROUP BY 1) SELECT CASE WHEN n < 32 THEN 'excluded' ELSE 'prepared' END AS status, CASE WHEN n < 32 THEN 'too_short' END AS reason, count(*) AS n FROM n GROUP BY 1, 2
  UNION ALL SELECT 'excluded', 'parse_error', 1""")
def src03(spark, d):
    """Prepared pieces and exclusions, with one damaged file among them."""
    damaged = spark.createDataFrame([("damaged.mxl", "<score-partwise><part>")], "piece_id string, content string")
    parsed = musicxml.parse_files(score_documents(spark, d).unionByName(damaged), events=False)
    return parsed.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@C.add("src01_discovery")
def src01(spark, d):
    """The table files themselves, found below the folder with length and hash."""
    return sinks.file_manifest(spark, d).where(F.col("path").rlike(r"(?i)\.parquet$")).select("path", "bytes")


@C.add("src04_csv_manifest", f"WITH {RECORDS_SQL} SELECT piece_id, title, composer FROM records WHERE title IS NOT NULL AND trim(title) <> '' AND composer IS NOT NULL AND trim(composer) <> ''")
def src04(spark, d):
    """A manifest written as CSV and read again."""
    rows = records(spark, d).where("trim(title) <> '' and trim(composer) <> ''").select("piece_id", "title", "composer")
    folder = scratch_folder(spark, "manifest")
    rows.write.csv(folder, header=True, escape='"')
    return catalogs.manifest(spark, folder).select("piece_id", "title", "composer")


@C.add("src05_nested_json", f"WITH {PIECES_SQL} SELECT CASE WHEN len(tokens) % 3 = 2 THEN 'missing_musicxml_encoding' ELSE 'written' END AS status, count(*) AS n FROM pieces GROUP BY 1")
def src05(spark, d):
    """A payload under an object, in an array or missing."""
    n = F.pmod(F.size("tokens"), F.lit(3))
    body = F.when(n == 0, F.concat(F.lit('{"encodings": {"musicxml": "'), "piece_id", F.lit('"}}'))).when(n == 1, F.concat(F.lit('{"encodings": [{"MusicXML": "'), "piece_id", F.lit('"}]}'))).otherwise('{"encodings": {}}')
    v = F.try_parse_json(body)
    spots = [f"$.encodings{i}.{k}" for i in ("", "[0]") for k in ("musicxml", "MusicXML")]
    payload = F.coalesce(*[F.try_variant_get(v, s, "string") for s in spots])
    return pieces(spark, d).select(F.when(payload.isNull(), "missing_musicxml_encoding").otherwise("written").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@C.add("src08_union_catalogs", f"WITH {RECORDS_SQL}, {PIECES_SQL} SELECT piece_id, title, NULL AS parts, 'records' AS catalog FROM records UNION ALL SELECT piece_id, title, metadata.part_count, 'pieces' FROM pieces")
def src08(spark, d):
    a = records(spark, d).select("piece_id", "title", F.lit("records").alias("catalog"))
    b = pieces(spark, d).select("piece_id", "title", F.col("metadata.part_count").alias("parts"), F.lit("pieces").alias("catalog"))
    return catalogs.union_catalogs([a, b])


@C.add("src10_cached_pieces", f"WITH {PIECES_SQL}, {RECORDS_SQL} SELECT piece_id, CAST(len(tokens) AS INTEGER) AS n FROM pieces WHERE piece_id IN (SELECT piece_id FROM records WHERE split = 'test')")
def src10(spark, d):
    """A cache in JSON lines, read for this run's selection alone."""
    folder = scratch_folder(spark, "cache")
    pieces(spark, d).select(F.lit("piece").alias("kind"), "piece_id", "tokens").write.json(folder)
    cache = spark.read.schema("kind string, piece_id string, tokens array<int>").json(folder)
    chosen = records(spark, d).where("split = 'test'").select("piece_id")
    return cache.where("kind = 'piece'").join(chosen, "piece_id", "left_semi").select("piece_id", F.size("tokens").alias("n"))


@C.add("src11_torn_json", f"WITH {METRICS_SQL} SELECT piece_id, model, frac FROM metrics")
def src11(spark, d):
    """A checkpoint whose last line is torn."""
    folder = scratch_folder(spark, "checkpoint")
    rows = metrics(spark, d).select("piece_id", "model", "frac")
    torn = spark.createDataFrame([('{"piece_id": "torn',)], "value string")
    sinks.strict_json(rows).union(torn).write.text(folder)
    return sinks.read_checkpoint(spark, folder, "piece_id string, model string, frac double")


@C.add("src13_csv_strings", f"WITH {METRICS_SQL} SELECT model, count(*) AS n, count(nll) AS n_finite FROM metrics GROUP BY 1")
def src13(spark, d):
    """Scores read as text and cast, what is no number becoming null."""
    folder = scratch_folder(spark, "artifact")
    metrics(spark, d).select("piece_id", "model", "nll").withColumn("nll", F.coalesce(F.col("nll").cast("string"), F.lit("n/a"))).write.csv(folder, header=True)
    return catalogs.manifest(spark, folder).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count(F.col("nll").try_cast("double")).alias("n_finite"))


@C.add("snk03_strict_json", "SELECT count(*) AS n, CAST(sum(CASE WHEN nll_per_token IS NULL OR NOT isfinite(nll_per_token) THEN 1 ELSE 0 END) AS BIGINT) AS n_null FROM piece_metrics")
def snk03(spark, d):
    value = sinks.strict_json(table(spark, d, "piece_metrics"))
    return value.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get_json_object("value", "$.nll_per_token").isNull()).alias("n_null"))


@C.add("snk04_resumed_cells", f"WITH {METRICS_SQL} SELECT model, frac, count(*) AS n FROM metrics WHERE model IS NOT NULL GROUP BY 1, 2")
def snk04(spark, d):
    """Half the cells are written, then a resumed run writes the missing ones and one anew."""
    folder = scratch_folder(spark, "cells")
    rows = metrics(spark, d).where("model is not null").select("piece_id", "nll", "model", "frac")
    sinks.write_cells(rows.where("frac < 1"), folder, "model", "frac")
    done = spark.read.parquet(folder)
    todo = sinks.pending(rows.select("model", "frac").distinct(), done, "model", "frac")
    again = rows.where("frac < 1").select("model", "frac").distinct().orderBy("model", "frac").limit(1)
    sinks.write_cells(rows.join(todo.union(again), ["model", "frac"], "left_semi"), folder, "model", "frac")
    return spark.read.parquet(folder).groupBy("model", "frac").agg(F.count(F.lit(1)).alias("n"))


@C.add("src16_manifest_check")
def src16(spark, d):
    """The files of the folder held against their own manifest."""
    found = sinks.file_manifest(spark, d)
    return sinks.compare_manifests(found, found).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@C.add("dq15_execution_plan", f"WITH {RECORDS_SQL}, n AS (SELECT count(*) AS n FROM records WHERE split = 'train') SELECT CAST(frac AS DOUBLE) AS frac, CAST(greatest(1, least(n, round_even(frac * n, 0))) AS BIGINT) AS n_train, 4 * 3 * 2 AS n_fits FROM n CROSS JOIN (VALUES (0.1), (0.25), (0.5), (0.75), (1.0)) f(frac)")
def dq15(spark, d):
    """What a comparison would fit, without fitting: models, seeds and fractions."""
    n = records(spark, d).where("split = 'train'").agg(F.count(F.lit(1)).alias("n"))
    grid = F.explode(F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 1.0)]))
    return n.withColumn("frac", grid).select("frac", F.greatest(F.lit(1), F.least("n", F.bround(F.col("frac") * F.col("n")))).cast("bigint").alias("n_train"), F.lit(4 * 3 * 2).alias("n_fits"))


@C.add("dq16_environment")
def dq16(spark, d):
    """Versions and settings a run is tied to."""
    rows = [("spark", spark.version), ("time_zone", spark.conf.get("spark.sql.session.timeZone")), ("shuffle_partitions", spark.conf.get("spark.sql.shuffle.partitions"))]
    return spark.createDataFrame(rows, "name string, value string")


def stream(spark, d):
    return ST.event_time(ST.file_stream(spark, f"{d.rstrip('/')}/events.parquet"))


@C.add("strm5_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def strm5(spark, d):
    """Events of each day and type, from a stream."""
    out = ST.tumbling(stream(spark, d), "ts", "1 day", "event_type")
    return ST.run_all(out, scratch_folder(spark, "tumbling"), scratch_folder(spark, "state"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@C.add("strm5_sliding", "SELECT b AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS b FROM events) GROUP BY 1")
def strm5b(spark, d):
    """Windows of a day that start every twelve hours."""
    out = ST.tumbling(stream(spark, d), "ts", "1 day", slide="12 hours")
    return ST.run_all(out, scratch_folder(spark, "sliding"), scratch_folder(spark, "state"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@C.add("strm5_sessions", """WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, s""")
def strm5c(spark, d):
    """Sessions of each user, parted by six hours, in batch form."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.sessions(rows, "ts", "6 hours", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@C.add("strm4_live_intervals", """WITH l AS (SELECT user_id, ts, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM events) SELECT user_id, count(*) AS n, count(i) AS n_intervals, round(sum(i), 6) AS total FROM l GROUP BY 1""")
def strm4(spark, d):
    """Differences of each user's values, the last value kept as state."""
    live = ST.live_intervals(ST.file_stream(spark, f"{d.rstrip('/')}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "value")
    out = ST.run_all(live, scratch_folder(spark, "intervals"), scratch_folder(spark, "state"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("interval").alias("n_intervals"), F.round(F.sum("interval"), 6).alias("total"))


@C.add("strm2_incremental_ingest", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def strm2(spark, d):
    """Ingested twice: the second time nothing is new."""
    source, target, state = f"{d.rstrip('/')}/events.parquet", scratch_folder(spark, "ingested"), scratch_folder(spark, "state")
    ST.ingest_new(spark, source, target, state)
    return ST.ingest_new(spark, source, target, state).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@C.add("src07_source_catalogs", f"""WITH {RECORDS_SQL} SELECT split_part(piece_id, '/', 1) AS source, piece_id, title, CASE WHEN split_part(piece_id, '/', 1) = 'symbtr' THEN split_part(regexp_extract(piece_id, '([^/]*)$', 1), '_', 1) END AS form,
  CASE WHEN split_part(piece_id, '/', 1) = 'pdmx' THEN n_events END AS declared_events FROM records""")
def src07(spark, d):
    """One builder a source, each with columns of its own, in one catalogue."""
    r = records(spark, d).withColumn("source", F.substring_index("piece_id", "/", 1))
    core = ["source", "piece_id", "title"]
    symbtr = r.where("source = 'symbtr'").select(*core, F.substring_index(F.substring_index("piece_id", "/", -1), "_", 1).alias("form"))
    pdmx = r.where("source = 'pdmx'").select(*core, F.col("n_events").alias("declared_events"))
    rest = r.where("source not in ('symbtr', 'pdmx')").select(*core)
    return catalogs.union_catalogs([symbtr, pdmx, rest])


@C.add("src12_annotation_csv", f"WITH {EVENTS_SQL} SELECT piece_id, t AS event_index, CAST(measure AS VARCHAR) AS segment_label FROM ev WHERE measure IS NOT NULL")
def src12(spark, d):
    """Annotations written as CSV and read with their schema; rows that don't fit it are dropped."""
    folder = scratch_folder(spark, "annotations")
    rows = events(spark, d).where("measure is not null").select("piece_id", F.col("t").cast("string").alias("event_index"), F.col("measure").cast("string").alias("segment_label"))
    bad = spark.createDataFrame([("x", "not a number", "1"), ("x", "-1", "1")], "piece_id string, event_index string, segment_label string")
    rows.unionByName(bad).write.csv(folder, header=True)
    read = spark.read.schema("piece_id string, event_index int, segment_label string, _torn string").option("columnNameOfCorruptRecord", "_torn").csv(folder, header=True)
    return read.where("_torn is null and event_index >= 0").select("piece_id", "event_index", "segment_label")


@C.add("src15_eligible_rows", f"WITH {METRICS_SQL} SELECT piece_id, model, nll FROM metrics WHERE abs(frac - 1) <= 1e-9 AND nll >= 0 AND model <> 'vomm'")
def src15(spark, d):
    """Rows that may be used, the conditions reaching the scan of the written table."""
    folder = scratch_folder(spark, "costs")
    metrics(spark, d).write.parquet(folder)
    return spark.read.parquet(folder).where((F.abs(F.col("frac") - 1) <= 1e-9) & (F.col("nll") >= 0) & (F.col("model") != "vomm")).select("piece_id", "model", "nll")


@C.add("snk01_tables", f"WITH {RECORDS_SQL}, {PIECES_SQL} SELECT 'records' AS name, count(*) AS n FROM records UNION ALL SELECT 'pieces', count(*) FROM pieces")
def snk01(spark, d):
    """Two tables written as CSV and counted again."""
    folder = scratch_folder(spark, "tables")
    sinks.write_tables({"records": records(spark, d).select("piece_id", "split"), "pieces": pieces(spark, d).select("piece_id", "n_events")}, folder)
    count = lambda name: spark.read.csv(f"{folder}/{name}", header=True).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count("records").union(count("pieces"))


@C.add("snk12_split_manifest", f"WITH {RECORDS_SQL} SELECT '{{\"split\":\"' || split || '\",\"n\":' || count(*) || '}}' AS manifest FROM records WHERE split IS NOT NULL GROUP BY split")
def snk12(spark, d):
    """A JSON object a split."""
    counts = records(spark, d).where("split is not null").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_json(F.struct("split", "n")).alias("manifest"))


@C.add("snk14_fresh_folder", "SELECT true AS refused")
def snk14(spark, d):
    """A folder that is there already is not written over."""
    folder = scratch_folder(spark, "fresh")
    rows = records(spark, d).select("piece_id")
    rows.write.parquet(folder)
    try:
        rows.write.mode("errorifexists").parquet(folder)
        refused = False
    except AnalysisException:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


@C.add("jon11_planned_grid", f"WITH {METRICS_SQL}, m AS (SELECT DISTINCT model FROM metrics WHERE model IS NOT NULL), s AS (SELECT DISTINCT data_seed FROM metrics WHERE data_seed IS NOT NULL) SELECT model, data_seed, CAST(frac AS DOUBLE) AS frac FROM m CROSS JOIN s CROSS JOIN (VALUES (0.1), (0.25), (0.5), (0.75), (1.0)) f(frac)")
def jon11(spark, d):
    """Models by seeds by fractions: a plan of a few rows."""
    m = metrics(spark, d)
    seeds = m.where("data_seed is not null").select("data_seed").distinct()
    fractions = F.explode(F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 1.0)]))
    return m.where("model is not null").select("model").distinct().crossJoin(F.broadcast(seeds)).select("model", "data_seed", fractions.alias("frac"))


@C.add("jon07_manifest_changes")
def jon07(spark, d):
    """A manifest held against a changed copy of itself."""
    now = sinks.file_manifest(spark, d).where(F.col("path").rlike(r"(?i)\.parquet$"))
    then = now.where("not path like 'part.%'").withColumn("sha256", F.when(F.col("path").like("nation%"), "0").otherwise(F.col("sha256")))
    return sinks.compare_manifests(then, now).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
