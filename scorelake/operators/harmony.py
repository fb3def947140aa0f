"""Chord states, modal contexts and how well pitch-class sets fit them.

All of these are fixed tables of at most a few thousand rows. Scores are made once for each
distinct set of pitch classes (at most 4 096), never for each piece.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the pitch classes, modes, and chords as (symbol, level, intervals).
NAMES = "C C# D D# E F F# G G# A A# B".split()
MODES = {
    "ionian": (0, 2, 4, 5, 7, 9, 11),
    "dorian": (0, 2, 3, 5, 7, 9, 10),
    "phrygian": (0, 1, 3, 5, 7, 8, 10),
    "lydian": (0, 2, 4, 6, 7, 9, 11),
    "mixolydian": (0, 2, 4, 5, 7, 9, 10),
    "aeolian": (0, 2, 3, 5, 7, 8, 10),
    "locrian": (0, 1, 3, 5, 6, 8, 10),
}
CHORDS = [
    ("maj", "triad", (0, 4, 7)), ("min", "triad", (0, 3, 7)), ("dim", "triad", (0, 3, 6)), ("aug", "triad", (0, 4, 8)),
    ("maj7", "seventh", (0, 4, 7, 11)), ("7", "seventh", (0, 4, 7, 10)), ("m7", "seventh", (0, 3, 7, 10)),
    ("m(maj7)", "seventh", (0, 3, 7, 11)), ("ø7", "seventh", (0, 3, 6, 10)), ("dim7", "seventh", (0, 3, 6, 9)),
    ("6", "sixth", (0, 4, 7, 9)), ("m6", "sixth", (0, 3, 7, 9)), ("add9", "added", (0, 2, 4, 7)), ("madd9", "added", (0, 2, 3, 7)),
    ("sus2", "suspended", (0, 2, 7)), ("sus4", "suspended", (0, 5, 7)), ("7sus4", "seventh", (0, 5, 7, 10)),
    ("maj9", "ninth", (0, 2, 4, 7, 11)), ("9", "ninth", (0, 2, 4, 7, 10)), ("m9", "ninth", (0, 2, 3, 7, 10)), ("6/9", "ninth", (0, 2, 4, 7, 9)),
]
CHORD_MASS, MODAL_MASS, OUTSIDE_MASS = 0.72, 0.20, 0.08


def compatible_modes(intervals: tuple[int, ...]) -> list[str]:
    return [m for m, scale in MODES.items() if set(intervals) <= set(scale)]


def emission(root: int, intervals: tuple[int, ...]) -> list[float]:
    """Probability of each pitch class: most on the chord, some on its modes' other tones, little outside."""
    chord = {(root + i) % 12 for i in intervals}
    modal = {(root + i) % 12 for m in compatible_modes(intervals) for i in MODES[m]} - chord
    outside = set(range(12)) - chord - modal
    rest = OUTSIDE_MASS + (0.0 if modal else MODAL_MASS)
    p = [CHORD_MASS / len(chord) if x in chord else MODAL_MASS / len(modal) if x in modal else rest / len(outside) for x in range(12)]
    total = sum(p)
    return [x / total for x in p]


def chord_states(spark: SparkSession) -> DataFrame:
    """``(state, label, root, symbol, level, tones, modes)``: every chord on every root, root first."""
    rows = [
        (r * len(CHORDS) + i, f"{NAMES[r]}:{s}", r, s, level, sorted((r + x) % 12 for x in iv), compatible_modes(iv))
        for r in range(12) for i, (s, level, iv) in enumerate(CHORDS)
    ]
    return spark.createDataFrame(rows, "state int, label string, root int, symbol string, level string, tones array<int>, modes array<string>")


def modal_contexts(spark: SparkSession) -> DataFrame:
    """``(context, label, tonic, mode, tones)``: every mode on every tonic."""
    rows = [(t * 7 + i, f"{NAMES[t]}:{m}", t, m, sorted((t + x) % 12 for x in scale)) for t in range(12) for i, (m, scale) in enumerate(MODES.items())]
    return spark.createDataFrame(rows, "context int, label string, tonic int, mode string, tones array<int>")


def emissions(spark: SparkSession) -> DataFrame:
    """``(state, pc, p)``."""
    rows = [(r * len(CHORDS) + i, pc, p) for r in range(12) for i, (_, _, iv) in enumerate(CHORDS) for pc, p in enumerate(emission(r, iv))]
    return spark.createDataFrame(rows, "state int, pc int, p double")


def transition_scores(spark: SparkSession) -> DataFrame:
    """``(i, j, p)``: rule-based moves between chord states: staying, same root, a fifth, shared modes."""
    state = [(r, level, set(compatible_modes(iv))) for r in range(12) for _, level, iv in CHORDS]
    rows = []
    for i, (r, level, modes) in enumerate(state):
        w = [
            1.0 + 2.5 * (i == j) + (0.8 + 0.3 * (level == l2)) * (r == r2) + 0.4 * ((r2 - r) % 12 in (5, 7)) + 0.3 * bool(modes & m2)
            for j, (r2, l2, m2) in enumerate(state)
        ]
        total = math.fsum(w)
        rows += [(i, j, x / total) for j, x in enumerate(w)]
    return spark.createDataFrame(rows, "i int, j int, p double")


def move_relations() -> list[np.ndarray]:
    """What :func:`transition_scores` depends on, each as a table of states by states: any two, shared modes, a fifth, same root and level with their conjunctions, staying."""
    state = [(r, level, set(compatible_modes(iv))) for r in range(12) for _, level, iv in CHORDS]
    holds = lambda f: np.array([[bool(f(a, b)) for b in state] for a in state])
    modes, fifth = holds(lambda a, b: a[2] & b[2]), holds(lambda a, b: (b[0] - a[0]) % 12 in (5, 7))
    root, level = holds(lambda a, b: a[0] == b[0]), holds(lambda a, b: a[1] == b[1])
    return [np.ones_like(root), modes, fifth, fifth & modes, root, root & modes, root & level, root & level & modes, np.eye(len(state), dtype=bool)]


def with_bits(df: DataFrame, pitch_classes: str) -> DataFrame:
    """Adds ``bits``: the set of pitch classes as a 12-bit number."""
    bit = lambda x: F.pow(F.lit(2), F.pmod(x, F.lit(12))).cast("int")
    return df.withColumn("bits", F.aggregate(F.array_distinct(F.transform(pitch_classes, lambda x: F.pmod(x, F.lit(12)))), F.lit(0), lambda a, x: a + bit(x)))


def _profile(sets: DataFrame) -> DataFrame:
    """``(bits, pc, w)``: each set's even profile; the empty set's is even over all."""
    pcs = F.sequence(F.lit(0), F.lit(11))
    has = lambda pc: (F.col("bits") == 0) | (F.pmod(F.floor(F.col("bits") / F.pow(F.lit(2), pc)), F.lit(2)) == 1)
    return sets.select("bits").distinct().withColumn("in", F.filter(pcs, has)).select("bits", F.explode("in").alias("pc"), (1.0 / F.size("in")).alias("w"))


def chord_candidates(sets: DataFrame, n: int = 5) -> DataFrame:
    """``(bits, place, label, score)``: the chords that fit each distinct set best, the first state of equals."""
    spark = sets.sparkSession
    e = F.broadcast(emissions(spark))  # 252 x 12 rows
    s = _profile(sets).join(e, "pc").groupBy("bits", "state").agg(F.round(F.sum(F.col("w") * F.ln(F.col("p") + 1e-12)), 9).alias("score"))
    return _best(s, "state", n).join(F.broadcast(chord_states(spark).select("state", "label")), "state").select("bits", "place", "label", "score")


def mode_candidates(sets: DataFrame, n: int = 3) -> DataFrame:
    """``(bits, place, label, score)``: inside minus 0.6 of outside, the first context of equals."""
    spark = sets.sparkSession
    m = F.broadcast(modal_contexts(spark))  # 84 rows
    inside = F.sum(F.when(F.array_contains("tones", F.col("pc")), F.col("w")).otherwise(0.0))
    s = _profile(sets).crossJoin(m.select("context", "tones")).groupBy("bits", "context").agg(F.round(inside - 0.6 * (1 - inside), 9).alias("score"))
    return _best(s, "context", n).join(m.select("context", "label"), "context").select("bits", "place", "label", "score")


def _best(scores: DataFrame, key: str, n: int) -> DataFrame:
    by = Window.partitionBy("bits").orderBy(F.desc("score"), key)
    return scores.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)
