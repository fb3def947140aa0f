"""Problem 2: cutting oversized items at natural boundaries.

Boundary strengths come from the events: a new measure after a rest, a new measure, a rest. A
sparse table over a piece's strengths answers range-maximum queries in constant time. The cutter
asks it for the strongest cut in the preferred window of lengths, then in all lengths above the
overlap, takes the rightmost of equals, and steps back by the overlap. The same table lists the
natural boundaries: the maximum of a range is reported and the range is split there until no
boundary is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import merged, pieces


def sparse_table(strength: np.ndarray) -> list[np.ndarray]:
    """Level k holds, for each i, the position of the rightmost maximum of [i, i + 2^k)."""
    levels = [np.arange(len(strength))]
    step = 1
    while 2 * step <= len(strength):
        left, right = levels[-1][:-step], levels[-1][step:]
        levels.append(np.where(strength[right] >= strength[left], right, left))
        step *= 2
    return levels


def strongest(levels: list[np.ndarray], strength: np.ndarray, lo: int, hi: int) -> int:
    """Position of the rightmost maximum of strength[lo:hi]."""
    k = (hi - lo).bit_length() - 1
    a, b = levels[k][lo], levels[k][hi - (1 << k)]
    return int(b if strength[b] >= strength[a] else a)


def reported(levels: list[np.ndarray], strength: np.ndarray, least: int) -> list[int]:
    """Positions of at least ``least``, by splitting ranges at their maximum, in order."""
    out, todo = [], [(0, len(strength))]
    while todo:
        lo, hi = todo.pop()
        if lo < hi and strength[top := strongest(levels, strength, lo, hi)] >= least:
            out.append(top)
            todo += [(lo, top), (top + 1, hi)]
    return sorted(out)


#: Strengths of a boundary before an event; a new measure is always the stronger.
REST, MEASURE, MEASURE_AFTER_REST = 1, 2, 3


def cut_points(
    strength: np.ndarray, limit: int, overlap: int, least: int, n: int | None = None, levels: list[np.ndarray] | None = None
) -> list[tuple[int, int]]:
    """Pieces [start, stop) of at most ``limit`` tokens covering the item of n tokens (default all of ``strength``).

    A cut before token i has strength[i]. Lengths from ``least`` on are preferred; where no
    measure begins there, a stronger cut at any length above the overlap is taken, so every step
    moves on. The next piece starts ``overlap`` before one ends. Without any boundary the cut
    falls at the limit.
    """
    n = len(strength) if n is None else n
    levels = sparse_table(strength) if levels is None else levels
    out, start = [], 0
    while n - start > limit:
        stop = strongest(levels, strength, start + least, start + limit + 1)
        if strength[stop] < MEASURE:
            other = strongest(levels, strength, start + overlap + 1, start + limit + 1)
            if strength[other] > strength[stop]:
                stop = other
        out.append((start, stop))
        start = stop - overlap
    out.append((start, n))
    return out


def strengths(prepared: DataFrame, events: DataFrame, limit: int = 256, gap: float = 0.02) -> DataFrame:
    """``(piece_id, event_index, strength)`` of all boundaries in pieces above ``limit`` tokens.

    A measure begins at an event whose measure is known and differs from the last known measure
    before it by index; a piece's first known measure is none. A rest is a gap of more than
    ``gap`` between the end of the event before and the event. Repeated rows of an event are one
    event (rows with a measure first, then the latest extraction, ties by the larger measure,
    offset and duration); rows without piece_id or index are ignored; a null or NaN time is no
    rest. Measure numbers may start again or stand still. The windows run within one piece, so no
    partition is larger than a piece.
    """
    long = pieces(prepared.select("piece_id", "tokens", "prepared_at")).where(F.size("tokens") > limit).select("piece_id")
    rows = events.where("index is not null").select("piece_id", "index", "measure", "offset", "duration", "extracted_at")
    latest = Window.partitionBy("piece_id", "index").orderBy(
        F.col("measure").isNull(), F.desc("extracted_at"), F.desc("measure"), F.desc("offset"), F.desc("duration")
    )
    by_index = Window.partitionBy("piece_id").orderBy("index")
    stop = F.col("offset") + F.col("duration")
    rest = F.coalesce((F.col("offset") - F.lag(stop).over(by_index) > gap + 1e-9) & ~F.isnan("offset") & ~F.isnan(F.lag(stop).over(by_index)), F.lit(False))
    before = F.last("measure", ignorenulls=True).over(by_index.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("measure") != before, F.lit(False))
    strength = F.when(fresh & rest, MEASURE_AFTER_REST).when(fresh, MEASURE).when(rest, REST)
    return (
        rows.join(merged(long), "piece_id", "left_semi")
        .repartition("piece_id")
        .withColumn("rank", F.row_number().over(latest))
        .where("rank = 1")
        .select("piece_id", F.col("index").alias("event_index"), strength.alias("strength"))
        .where("strength is not null")
    )


def indexed(
    prepared: DataFrame, events: DataFrame, limit: int = 256, overlap: int = 32, least: int | None = None
) -> DataFrame:
    """``(piece_id, boundaries, parts)`` of every piece above ``limit`` tokens, both read off its range-maximum index.

    ``boundaries`` lists where a measure begins; ``parts`` are (start, stop, strength, natural),
    the strength that of the cut at the part's end. ``least`` is the shortest part preferred
    before the last (default half the limit).
    """
    least = limit // 2 if least is None else least
    if not overlap < least <= limit:
        raise ValueError("overlap < least <= limit must hold")
    long = pieces(prepared.select("piece_id", "tokens", "prepared_at")).where(F.size("tokens") > limit)
    marks = strengths(prepared, events, limit).groupBy("piece_id").agg(
        F.collect_list(F.struct("event_index", "strength")).alias("marks")  # at most one an event of the piece
    )
    schema = "piece_id string, boundaries array<int>, parts array<struct<start:int,stop:int,strength:int,natural:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, parts = [], []
            for n, marked in zip(batch.column("n").to_pylist(), batch.column("marks")):
                pairs = marked.values
                at = pairs.field("event_index").to_numpy() if pairs is not None else np.empty(0, np.int64)
                strength = np.zeros(max(n, int(at.max(initial=-1)) + 1), dtype=np.int8)
                if len(at):
                    kept = at >= 0
                    strength[at[kept]] = pairs.field("strength").to_numpy()[kept]
                levels = sparse_table(strength)
                bounds.append(reported(levels, strength, MEASURE))
                parts.append(
                    [
                        {"start": a, "stop": b, "strength": int(strength[b]) if b < n else 0, "natural": bool(b == n or strength[b] > 0)}
                        for a, b in cut_points(strength, limit, overlap, least, n, levels)
                    ]
                )
            part = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("strength", pa.int32()), ("natural", pa.bool_())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("piece_id"), pa.array(bounds, pa.list_(pa.int32())), pa.array(parts, pa.list_(part))], ["piece_id", "boundaries", "parts"]
            )

    return long.select("piece_id", F.size("tokens").alias("n")).join(merged(marks), "piece_id", "left").mapInArrow(run, schema)


def cuts(prepared: DataFrame, events: DataFrame, **options) -> DataFrame:
    """``(piece_id, part, start, stop, strength, natural)``: the parts of every piece above the limit.

    ``natural`` tells if the part ends at a boundary or at the end of the piece.
    """
    return indexed(prepared, events, **options).select("piece_id", F.posexplode("parts").alias("part", "p")).select("piece_id", "part", "p.*")


def found(prepared: DataFrame, events: DataFrame, limit: int = 256) -> DataFrame:
    """``(piece_id, event_index)``: where a measure begins, listed by the index that the cutter asks."""
    return indexed(prepared, events, limit).select("piece_id", F.explode("boundaries").alias("event_index"))
