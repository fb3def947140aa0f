"""Problem 4: long exact spans shared between records.

Recompression. Rounds replace runs of one symbol, then pairs of symbols, by names. A round first
marks in every record the runs or pairs to be named, groups them over the whole corpus, gives
each distinct one a number of its own, and joins the numbers back. A name therefore stands for
one string of tokens everywhere, and equal names mean equal tokens. A pair is only formed from a
left symbol and a right symbol (a bit of the name decides), so pairs can't overlap and equal
substrings get equal symbols except near their ends. The lengths of symbols are bounded per
round, so every window of ``length`` tokens keeps at least one whole symbol that depends on the
window alone: its inner zone, which is followed window by window through the rounds.

A window can only stand in another record if its inner symbols do (three in a row where it has as
many), which one aggregation over the high-level symbols reveals. Windows that pass are verified
by grouping them on their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import as_list, copies, flat, in_parts, merged, pieces
from scorelake.session import cut_lineage

U = np.uint64
#: A dictionary of names is broadcast up to this many rows (24 bytes each); beyond, it is joined by merge.
BROADCAST_NAMES = 20_000


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def is_right(name: np.ndarray, round_no: int) -> np.ndarray:
    """Whether a symbol may only be the second of a pair in this round."""
    with np.errstate(over="ignore"):
        return (mix(name.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + U(round_no + 1)) & U(1)).astype(bool)


def rounds_for(length: int) -> list[tuple[str, int]]:
    """Rounds as (kind, longest symbol made), such that both ends lose less than ``length``.

    A run round loses at most its bound at an end, a pair round at most the longest symbol
    before it; the sum over one end must stay below half the window.
    """
    plan, lost, longest = [], 0, 1
    while True:
        run = longest + 2 if not plan else longest
        # a pair round follows every run round
        if 2 * (lost + run + run) >= length:
            return plan
        plan += [("run", run), ("pair", run + (1 if not plan else run))]
        lost += 2 * run
        longest = plan[-1][1]


@dataclass
class Symbols:
    """Symbols of records laid end to end: each with its record, name, start, size and whether it joins nothing."""

    owner: np.ndarray
    name: np.ndarray
    start: np.ndarray
    size: np.ndarray
    fixed: np.ndarray

    def run_edges(self) -> np.ndarray:
        return np.r_[True, (self.name[1:] != self.name[:-1]) | (self.owner[1:] != self.owner[:-1])][: len(self.name)]

    def marked(self, kind: str, bound: int, round_no: int) -> tuple[Symbols, np.ndarray, np.ndarray, np.ndarray]:
        """The symbols after a round, with the positions still to be named and the two parts of each new name."""
        if not len(self.name):
            none = np.empty(0, np.int64)
            return self, none, none, none
        if kind == "run":
            edge = self.run_edges()
            run, first = np.cumsum(edge) - 1, np.flatnonzero(edge)
            count = np.diff(np.r_[first, len(self.name)])
            total = count * self.size[first]
            joined = (count > 1) & (total <= bound)
            keep = edge | ~joined[run]
            fresh = (edge & joined[run])[keep]
            size = np.where(edge & joined[run], total[run], self.size)[keep]
            fixed = (self.fixed | ((count > 1) & ~joined)[run])[keep]
            second = count[run][keep]
        else:
            right = is_right(self.name, round_no)
            pair = np.zeros(len(self.name), dtype=bool)
            pair[:-1] = (
                ~right[:-1] & right[1:] & ~self.fixed[:-1] & ~self.fixed[1:]
                & (self.owner[:-1] == self.owner[1:]) & (self.size[:-1] + self.size[1:] <= bound)
            )
            keep = ~np.r_[False, pair[:-1]]
            fresh, fixed = pair[keep], self.fixed[keep]
            size = np.where(pair, self.size + np.r_[self.size[1:], 0], self.size)[keep]
            second = np.r_[self.name[1:], 0][keep]
        at = np.flatnonzero(fresh)
        out = Symbols(self.owner[keep], self.name[keep], self.start[keep], size, fixed)
        return out, at, out.name[at], second[at]

    def zone(self, kind: str, bound: int, round_no: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows whose part [lo, hi) is parsed alike wherever they stand, what of it stays so after a round."""
        if not len(lo):
            return lo, hi
        stop = self.start + self.size
        i = np.minimum(np.searchsorted(self.start, lo), len(self.start) - 1)
        j = np.minimum(np.searchsorted(stop, hi), len(self.start) - 1)
        if kind == "run":
            edge = self.run_edges()
            run, first = np.cumsum(edge) - 1, np.flatnonzero(edge)
            run_start, run_stop = self.start[first], stop[np.r_[first[1:] - 1, len(stop) - 1]]
            seen = np.maximum(np.minimum(run_stop[run[i]], hi) - lo, 0)
            new_lo = np.where(seen <= bound, lo + seen, lo)
            seen = np.maximum(hi - np.maximum(run_start[run[j]], lo), 0)
            new_hi = np.where(seen <= bound, hi - seen, hi)
        else:
            # a left symbol is never the second of a pair, a right one never the first
            right = is_right(self.name, round_no)
            new_lo, new_hi = np.where(right[i], stop[i], lo), np.where(right[j], hi, self.start[j])
        lo = np.minimum(new_lo, hi)
        return lo, np.maximum(new_hi, lo)


STATE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *(T.StructField(c, T.ArrayType(t)) for c, t in (
            ("name", T.LongType()), ("size", T.IntegerType()), ("fixed", T.BooleanType()), ("lo", T.IntegerType()), ("hi", T.IntegerType()),
            ("at", T.IntegerType()), ("first", T.LongType()), ("second", T.LongType()),
        )),
    ]
)


def begun(tokens: np.ndarray, lengths: np.ndarray, length: int) -> tuple[Symbols, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of one token each, and for every window its record and its zone, the whole window."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    symbols = Symbols(owner, tokens.astype(np.int64), np.arange(len(tokens)), np.ones(len(tokens), np.int64), np.zeros(len(tokens), bool))
    counts = np.maximum(lengths - length + 1, 0)
    windows = np.repeat(np.arange(len(lengths)), counts)
    lo = np.cumsum(lengths)[windows] - lengths[windows] + np.arange(len(windows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return symbols, windows, lo, lo + length


def named(part: pa.RecordBatch) -> tuple[Symbols, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, windows and zones of a state whose marked positions have been given names."""
    name, lengths = flat(part.column("name"))
    size, _ = flat(part.column("size"))
    fixed, _ = flat(part.column("fixed"), False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    size = size.astype(np.int64)
    start = np.cumsum(size) - size
    given = part.column("given")
    pairs, counts = given.flatten(), np.diff(given.offsets.to_numpy())
    if len(pairs):
        at, new = (pairs.field(k).to_numpy(zero_copy_only=False) for k in ("at", "new"))
        base = np.cumsum(lengths) - lengths
        name = name.copy()
        name[np.repeat(base, counts) + at] = new
    token_base = np.r_[0, np.cumsum(size)][np.cumsum(lengths) - lengths] if len(lengths) else np.empty(0, np.int64)
    lo, n_windows = flat(part.column("lo"))
    hi, _ = flat(part.column("hi"))
    windows = np.repeat(np.arange(len(lengths)), n_windows)
    return Symbols(owner, name, start, size, fixed.astype(bool)), windows, lo + token_base[windows], hi + token_base[windows]


def state_after(ids: pa.Array, symbols: Symbols, windows: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: tuple[str, int], round_no: int) -> pa.RecordBatch:
    """One round: zones are followed, the runs or pairs to be named are marked."""
    lo, hi = symbols.zone(*step, round_no, lo, hi)
    after, at, first, second = symbols.marked(*step, round_no)
    n = len(ids)
    per = np.bincount(after.owner, minlength=n)
    base = np.cumsum(per) - per
    tokens = np.bincount(symbols.owner, symbols.size, n).astype(np.int64)
    token_base = np.cumsum(tokens) - tokens
    marks, per_window = np.bincount(after.owner[at], minlength=n), np.bincount(windows, minlength=n)
    small = lambda x: x.astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            ids, as_list(after.name, per), as_list(small(after.size), per), as_list(after.fixed, per),
            as_list(small(lo - token_base[windows]), per_window), as_list(small(hi - token_base[windows]), per_window),
            as_list(small(at - base[after.owner[at]]), marks), as_list(first, marks), as_list(second, marks),
        ],
        STATE.names,
    )


def name_globally(state: DataFrame, round_no: int) -> DataFrame:
    """``state`` with ``given``: a number for each marked run or pair, the same wherever it stands in the corpus."""
    marks = state.select("id", F.explode(F.arrays_zip("at", "first", "second")).alias("m")).select("id", "m.at", "m.first", "m.second")
    # tokens are below 2^31; numbers of a round are above those of the rounds before
    number = F.monotonically_increasing_id() + F.lit((round_no + 1) << 57)
    names = cut_lineage(marks.select("first", "second").distinct().withColumn("new", number))
    side = F.broadcast(names) if names.count() <= BROADCAST_NAMES else merged(names)
    given = marks.join(side, ["first", "second"]).groupBy("id").agg(F.collect_list(F.struct("at", "new")).alias("given"))
    none = F.array().cast("array<struct<at:int,new:bigint>>")
    return state.drop("at", "first", "second").join(merged(given), "id", "left").withColumn("given", F.coalesce("given", none))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(a.astype(np.int64).view(U) + U(901)) * U(0x9E3779B97F4A7C15) + b.astype(np.int64).view(U)).view(np.int64)


class Inner:
    """The inner symbols of every window once all rounds are done.

    Three (two, one) symbols in a row are told by a 64-bit key of their names. Keys only choose
    windows to verify, so equal keys of different symbols cost work and change nothing.
    """

    def __init__(self, symbols: Symbols, windows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.owner, self.windows = symbols.owner, windows
        name = np.r_[symbols.name, 0, 0]
        two = combine(name[:-1], name[1:])
        self.grams = [symbols.name, two[:-1], combine(two[:-1], name[2:])]
        self.first = np.searchsorted(symbols.start, lo)
        self.last = np.searchsorted(symbols.start + symbols.size, hi, side="right") - 1
        self.width = np.clip(self.last - self.first + 1, 0, 3)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(record, key), distinct, of what the windows need."""
        owners, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for w in (1, 2, 3):
            at = self.width == w
            if at.any():
                wanted = np.zeros(len(self.owner) + 1, dtype=np.int64)
                np.add.at(wanted, self.first[at], 1)
                np.add.at(wanted, self.last[at] - w + 2, -1)
                chosen = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                owners.append(self.owner[chosen])
                keys.append(self.grams[w - 1][chosen])
        o, k = np.concatenate(owners), np.concatenate(keys)
        order = np.lexsort((k, o))
        o, k = o[order], k[order]
        fresh = np.r_[True, (o[1:] != o[:-1]) | (k[1:] != k[:-1])][: len(o)]
        return o[fresh], k[fresh]

    def candidates(self, owners: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Indices of the windows all of whose inner symbols are among the given (record, key)."""
        known = np.unique(combine(keys, owners))
        good = self.width < 1  # no inner symbol: only the tokens can tell
        for w in (1, 2, 3):
            at = self.width == w
            if at.any():
                missing = np.r_[0, np.cumsum(~np.isin(combine(self.grams[w - 1], self.owner), known))]
                good[at] = missing[self.last[at] - w + 2] == missing[self.first[at]]
        return np.flatnonzero(good)


def window_strings(tokens: np.ndarray, at: np.ndarray, length: int) -> list[bytes]:
    """The tokens of windows themselves as bytes: one byte a token where all are below 254, else eight."""
    if not len(at):
        return []
    view = np.lib.stride_tricks.sliding_window_view(tokens, length)[at]
    short = ((view >= -1) & (view < 254)).all(1)
    out: list[bytes] = [b""] * len(at)
    packed = np.ascontiguousarray((view[short] + 2).astype(np.uint8)).view(f"S{length}").ravel().tolist()
    for i, b in zip(np.flatnonzero(short).tolist(), packed):
        out[i] = b
    for i in np.flatnonzero(~short).tolist():
        out[i] = b"\x00" + view[i].astype(">i8").tobytes()
    return out


def recompressed(classes: DataFrame, length: int) -> DataFrame:
    """The state of ``classes(id, tokens)`` after all rounds, every symbol named."""
    plan = rounds_for(length)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, "tokens"):
            yield state_after(part.column("id"), *begun(*flat(part.column("tokens")), length), plan[0] if plan else ("run", 0), 0)

    state = classes.select("id", "tokens").mapInArrow(start, STATE)
    for r in range(len(plan)):
        whole = name_globally(cut_lineage(state), r)
        if r + 1 == len(plan):
            return whole
        step = plan[r + 1]

        def advance(batches: Iterator[pa.RecordBatch], r: int = r, step: tuple[str, int] = step) -> Iterator[pa.RecordBatch]:
            for part in in_parts(batches, "name"):
                yield state_after(part.column("id"), *named(part), step, r + 1)

        state = whole.mapInArrow(advance, STATE)
    none = F.array().cast("array<struct<at:int,new:bigint>>")
    return state.drop("at", "first", "second").withColumn("given", none)


def shared_windows(classes: DataFrame, length: int = 32) -> DataFrame:
    """``(id, start)`` of every window of ``length`` tokens of ``classes(id, tokens)`` that also stands in another class."""
    classes = classes.where(F.size("tokens") >= length)
    state = cut_lineage(recompressed(classes, length))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, "name"):
            owner, key = Inner(*named(part)).features()
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner)), pa.array(key)], ["id", "symbol"])

    symbols = cut_lineage(state.mapInArrow(features, "id bigint, symbol bigint"))
    in_two = symbols.groupBy("symbol").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("symbol")
    per_class = symbols.join(merged(in_two), "symbol").groupBy("id").agg(F.collect_list("symbol").alias("shared"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, "tokens"):
            tokens, lengths = flat(part.column("tokens"))
            keys, n = flat(part.column("shared"))
            inner = Inner(*named(part))
            chosen = inner.candidates(np.repeat(np.arange(len(n)), n), keys)
            _, windows, at, _ = begun(tokens, lengths, length)
            owner, at = windows[chosen], at[chosen]
            local = (at - (np.cumsum(lengths) - lengths)[owner]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(owner)), pa.array(local), pa.array(window_strings(tokens.astype(np.int64), at, length), pa.binary())],
                ["id", "start", "window"],
            )

    # no inner symbol can be missing where windows have none, so such classes stay
    whole = state.join(merged(per_class), "id", "left").join(merged(classes), "id").withColumn("shared", F.coalesce("shared", F.array().cast("array<bigint>")))
    windows = cut_lineage(whole.mapInArrow(pick, "id bigint, start int, window binary"))
    repeated = windows.groupBy("window").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("window")
    return windows.join(merged(repeated), "window").select("id", "start")


def spans(prepared: DataFrame, length: int = 32) -> DataFrame:
    """``(piece_id, start_pos, stop_pos)``: longest stretches of positions shared with other pieces.

    Pieces with equal tokens are one class and share all they have; windows are sought between
    classes. Repeats within one piece alone do not count; pieces below ``length`` tokens share
    nothing; null tokens equal each other; repeated deliveries are one piece.
    """
    items = pieces(prepared.select("piece_id", "tokens", "prepared_at")).where(F.size("tokens") >= length)
    classes, members = copies(items)
    starts = shared_windows(classes.select(F.col("class_id").alias("id"), "tokens"), length)
    single = starts.join(merged(classes.where("n_copies = 1").select(F.col("class_id").alias("id"))), "id")
    by_class = Window.partitionBy("id").orderBy("start")  # a record's own windows: bounded by its length
    runs = single.withColumn(
        "is_new", F.coalesce(F.col("start") > F.lag("start").over(by_class) + length, F.lit(True)).cast("int")
    ).withColumn("run", F.sum("is_new").over(by_class))
    stretches = runs.groupBy("id", "run").agg(F.min("start").alias("start_pos"), (F.max("start") + length).alias("stop_pos")).drop("run")
    whole = classes.where("n_copies > 1").select(F.col("class_id").alias("id"), F.lit(0).alias("start_pos"), F.size("tokens").alias("stop_pos"))
    return (
        cut_lineage(stretches.unionByName(whole))
        .join(merged(members.withColumnRenamed("class_id", "id")), "id")
        .select("piece_id", F.col("start_pos").cast("int").alias("start_pos"), F.col("stop_pos").cast("int").alias("stop_pos"))
    )


def shared_share(prepared: DataFrame, length: int = 32) -> DataFrame:
    """``(piece_id, n_tokens, n_shared, share)`` for every piece."""
    total = spans(prepared, length).groupBy("piece_id").agg(F.sum(F.col("stop_pos") - F.col("start_pos")).alias("n_shared"))
    items = pieces(prepared.select("piece_id", "tokens", "prepared_at")).select("piece_id", F.size("tokens").alias("n_tokens"))
    n = F.coalesce("n_shared", F.lit(0)).cast("long")
    return items.join(merged(total), "piece_id", "left").select(
        "piece_id", "n_tokens", n.alias("n_shared"), F.round(F.try_divide(n, F.col("n_tokens")), 6).alias("share")
    )
