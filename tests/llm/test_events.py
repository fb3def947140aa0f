"""Operators on events: natural cuts and runs."""

import datetime as dt

import numpy as np
import pytest

from scorelake.llm import p02_natural_cuts as p2
from scorelake.llm import p06_event_runs as p6

EVENTS = "piece_id string, index int, offset double, duration double, label string, measure int, extracted_at timestamp, last string, run int, rank int, key string"
PREPARED = "piece_id string, tokens array<int>, prepared_at timestamp, part int, n int, marks string"
DAY = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(*r, DAY, "x", 0, 0, "k") for r in rows], EVENTS)


def test_boundaries_follow_the_last_known_measure(spark):
    long = spark.createDataFrame([("a", [1] * 300, DAY, 0, 0, ""), ("a", [1] * 300, DAY, 0, 0, ""), ("b", [1] * 256, DAY, 0, 0, "")], PREPARED)
    measures = [None, 1, None, 1, 2, None, 2, 1, None, 3]
    rows = [("a", i, float(i), 1.0, "C4", m) for i, m in enumerate(measures)] + [("b", i, float(i), 1.0, "C4", i) for i in range(5)]
    rows += [rows[4], (None, 1, 0.0, 1.0, "C4", 9), ("a", None, 0.0, 1.0, "C4", 9)]
    got = {tuple(r) for r in p2.found(long, events(spark, rows[::-1])).collect()}
    assert got == {("a", 4), ("a", 7), ("a", 9)}


def test_cuts_cover_and_overlap(spark):
    long = spark.createDataFrame([("a", list(range(60)) * 12, DAY, 0, 0, "")], PREPARED)
    rows = [("a", i, float(i), 1.0, "C4", i // 50) for i in range(720)]
    parts = sorted((r["start"], r["stop"], r["natural"]) for r in p2.cuts(long, events(spark, rows)).collect())
    assert parts[0][0] == 0 and parts[-1][1] == 720 and all(b - a <= 256 for a, b, _ in parts)
    assert all(x[1] - y[0] == 32 for x, y in zip(parts, parts[1:])) and all(n for *_, n in parts)
    assert all(b % 50 == 0 for _, b, _ in parts[:-1])
    bare = sorted((r["start"], r["stop"], r["natural"]) for r in p2.cuts(long, events(spark, [])).collect())
    assert bare[0][:2] == (0, 256) and not bare[0][2]
    with pytest.raises(ValueError):
        p2.cuts(long, events(spark, []), overlap=200)


def test_cut_at_a_boundary_below_the_preferred_window(spark):
    long = spark.createDataFrame([("a", [1] * 300, DAY, 0, 0, "")], PREPARED)
    rows = [("a", i, float(i), 1.0, "C4", 1 + (i >= 100)) for i in range(300)]
    parts = sorted((r["start"], r["stop"], r["natural"]) for r in p2.cuts(long, events(spark, rows)).collect())
    assert parts == [(0, 100, True), (68, 300, True)]
    for at, stop in ((33, 33), (32, 256), (127, 127)):  # the overlap itself is no length
        strength = np.zeros(300)
        strength[at] = 1.0
        assert p2.cut_points(strength, 256, 32, 128)[0] == (0, stop)


def test_strengths_are_graded(spark):
    long = spark.createDataFrame([("a", [1] * 300, DAY, 0, 0, "")], PREPARED)
    # new measures at 140, 180 (after a rest) and 220, a rest alone at 250
    starts = [float(i) + 0.5 * (i >= 180) + 0.5 * (i >= 250) for i in range(300)]
    rows = [("a", i, starts[i], 1.0, "C4", 1 + (i >= 140) + (i >= 180) + (i >= 220)) for i in range(300)]
    got = {r["event_index"]: r["strength"] for r in p2.strengths(long, events(spark, rows)).collect()}
    assert got == {140: p2.MEASURE, 180: p2.MEASURE_AFTER_REST, 220: p2.MEASURE, 250: p2.REST}
    parts = sorted((r["start"], r["stop"], r["strength"]) for r in p2.cuts(long, events(spark, rows)).collect())
    assert parts == [(0, 180, 3), (148, 300, 0)]
    assert {r["event_index"] for r in p2.found(long, events(spark, rows)).collect()} == {140, 180, 220}


def test_index_reports_every_boundary():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        s = rng.integers(0, 4, n)
        assert p2.reported(p2.sparse_table(s), s, 2) == np.flatnonzero(s >= 2).tolist()


def test_sparse_table_takes_the_rightmost_maximum():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 3, 200).astype(float)
    levels = p2.sparse_table(s)
    for _ in range(300):
        lo = int(rng.integers(0, 199))
        hi = int(rng.integers(lo + 1, 201))
        best = max(range(lo, hi), key=lambda i: (s[i], i))
        assert p2.strongest(levels, s, lo, hi) == best


def test_runs_by_pitch_duration_and_time(spark):
    rows = [
        ("a", 0, 0.0, 1.0, "C#4", 1), ("a", 1, 1.01, 0.99, " d-4", 1), ("a", 2, 2.0, 1.0, "c#4", 1),  # a run of three spellings
        ("a", 3, 3.0, 1.03, "C#4", 1),  # differs by more than 0.02
        ("a", 4, 4.03, 1.03, "C#4", 1), ("a", 5, 5.09, 1.03, "C#4", 1),  # starts too late
        ("a", 7, 6.12, 1.03, "C#4", 1),  # an index is missing
        ("b", 0, 0.0, 1.0, "G4.C4", 1), ("b", 1, 1.0, 1.0, "C4.G4", 1), ("b", 2, 2.0, 1.0, "c4.g4", 1), ("b", 3, 3.0, 1.0, "C5.G4", 1),
        ("c", 0, 0.0, None, "C4", 1), ("c", 1, 1.0, 1.0, None, 1), ("c", 2, float("nan"), 1.0, "C4", 1), ("c", 3, 3.0, 1.0, "?", 1), ("c", 4, 4.0, 1.0, "?", 1),
    ]
    table = events(spark, (rows + rows[:4])[::-1] + [(None, 0, 0.0, 1.0, "C4", 1)])
    assert {tuple(r) for r in p6.found(table).collect()} == {("a", 0, 2), ("b", 0, 2)}
    runs = {(r["piece_id"], r["first_index"]): r for r in p6.runs(table).collect()}
    assert runs["a", 0]["n_events"] == 3 and abs(runs["a", 0]["total_duration"] - 2.99) < 1e-9
    assert runs["c", 3]["n_events"] == 2 and sum(r["n_events"] for r in runs.values()) == len(rows)


def test_enharmonic_keys(spark):
    pairs = [("B#3", "C4"), ("e-5", "D#5"), ("C4.E4.G4", "G4.c4.E4"), ("C-4", "B3"), ("F##4", "G4")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    from pyspark.sql import functions as F

    assert all(r[0] == r[1] for r in rows.select(p6.pitch_key(F.col("a")), p6.pitch_key(F.col("b"))).collect())


def test_empty_tables(spark):
    none = spark.createDataFrame([], EVENTS)
    assert p6.found(none).collect() == [] and p6.collapsed(none).collect() == []
    assert p2.found(spark.createDataFrame([], PREPARED), none).collect() == []
    assert p2.cuts(spark.createDataFrame([], PREPARED), none).collect() == []
