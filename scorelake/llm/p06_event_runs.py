"""Problem 6: repeated consecutive events.

Each event is compared with its predecessor in a lag window, changes are flagged, the running
sum of flags numbers the runs, and each run is aggregated into one event. One exchange by
piece serves the de-duplication, both windows and the aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Semitone of each natural note.
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def pitch_key(label: Column) -> Column:
    """The pitches a label names, as a sorted array of semitone numbers.

    Case and blanks mean nothing, ``#`` raises and ``-`` lowers by a semitone, notes of a chord
    are parted by dots and may stand in any order; B#3 and C4 are equal. A note without octave
    is kept apart from any with one. A label that can't be read is its own key.
    """
    plain = F.upper(F.regexp_replace(label, r"\s", ""))
    base = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])

    def semitone(note: Column) -> Column:
        octave = F.regexp_extract(note, r"(\d+)$", 1)
        sharps = F.length(note) - F.length(F.regexp_replace(note, "#", ""))
        flats = F.length(note) - F.length(F.regexp_replace(note, "-", ""))
        step = F.element_at(base, F.substring(note, 1, 1)) + sharps - flats
        return F.when(octave == "", step - 1000).otherwise(octave.cast("int") * 12 + step)

    readable = plain.rlike(r"^[A-G][#-]*\d*(\.[A-G][#-]*\d*)*$")
    notes = F.array_sort(F.array_distinct(F.transform(F.split(plain, r"\."), semitone)))
    return F.when(readable, F.concat_ws(".", notes.cast("array<string>"))).otherwise(F.concat(F.lit("?"), plain))


def labelled(events: DataFrame) -> DataFrame:
    """One row per event with its pitch key; labels are read once per distinct spelling in a task."""
    return events.where("piece_id is not null and index is not null").select(
        "piece_id", "index", "offset", "duration", "label", "extracted_at"
    )


def runs(events: DataFrame, duration_tolerance: float = 0.02, offset_tolerance: float = 0.02) -> DataFrame:
    """``(piece_id, first_index, last_index, n_events, label, start, total_duration)`` of every run.

    Two events are in one run if they are consecutive by index, name the same pitches, differ
    in duration by at most the one tolerance and the later starts within the other of the
    earlier's end. A run of one event is the event itself. Repeated rows are one event (the
    latest extraction wins, ties by label, offset and duration). A null or NaN label, offset or
    duration equals nothing. ``total_duration`` is the sum of the durations.
    """
    latest = Window.partitionBy("piece_id", "index").orderBy(
        F.desc("extracted_at"), F.desc("label"), F.desc("offset"), F.desc("duration")
    )
    by_index = Window.partitionBy("piece_id").orderBy("index")
    slack = 1e-9  # the tolerances are meant in decimals
    near = lambda x, y, tol: F.abs(x - y) <= tol + slack
    last = F.lag(F.struct("index", "key", "offset", "duration")).over(by_index)
    goes_on = (
        (F.col("last.index") + 1 == F.col("index"))
        & (F.col("last.key") == F.col("key"))
        & near(F.col("duration"), F.col("last.duration"), duration_tolerance)
        & near(F.col("offset"), F.col("last.offset") + F.col("last.duration"), offset_tolerance)
    )
    finite = ~F.isnan("offset") & ~F.isnan("duration") & ~F.isnan("last.offset") & ~F.isnan("last.duration")
    return (
        labelled(events)
        .withColumn("key", pitch_key(F.col("label")))
        .repartition("piece_id")
        .withColumn("rank", F.row_number().over(latest))
        .where("rank = 1")
        .withColumn("last", last)
        .withColumn("change", F.when(goes_on & finite, 0).otherwise(1))
        .withColumn("run", F.sum("change").over(by_index))
        .groupBy("piece_id", "run")
        .agg(
            F.min("index").alias("first_index"),
            F.max("index").alias("last_index"),
            F.count(F.lit(1)).cast("int").alias("n_events"),
            F.min_by("label", "index").alias("label"),
            F.min_by("offset", "index").alias("start"),
            F.sum("duration").alias("total_duration"),
        )
        .drop("run")
    )


def collapsed(events: DataFrame) -> DataFrame:
    """Every event of the corpus after collapsing its runs."""
    return runs(events).select(
        "piece_id", F.col("first_index").cast("int").alias("first_index"), F.col("last_index").cast("int").alias("last_index"),
        "n_events", F.upper(F.trim("label")).alias("label"), "start", F.round("total_duration", 6).alias("total_duration"),
    )


def found(events: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` events."""
    return (
        runs(events)
        .where(F.col("n_events") >= least)
        .select("piece_id", F.col("first_index").cast("int").alias("first_index"), F.col("last_index").cast("int").alias("last_index"))
    )
