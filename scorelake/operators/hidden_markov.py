"""Hidden Markov models over corpora of sequences.

Scoring and decoding run where the sequences are; fitting keeps the parameters (a few states by
a few symbols) on the driver and sends them to one job an iteration, which returns summed
counts. Many sequences are worked on together, step by step, in linear scale. They are laid out
for that once and kept, so an iteration reads a few large rows and sends back one of each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.scalars import uniform

TINY, TINIEST = 1e-12, np.finfo(float).tiny


@dataclass(frozen=True)
class Parameters:
    """Initial (K), transition (K x K) and emission (K x V) probabilities."""

    initial: np.ndarray
    transition: np.ndarray
    emission: np.ndarray

    @staticmethod
    def start(states: int, symbols: int, seed: int, concentration: float = 5.0) -> Parameters:
        rng = np.random.default_rng(seed)
        rows = lambda n, m: rng.dirichlet(np.full(m, concentration), n)
        return Parameters(rows(1, states)[0], rows(states, states), rows(states, symbols))


def example_parameters(states: int = 3, symbols: int = 12) -> Parameters:
    """A small fixed model: sticky states whose emissions are rotations of one ramp."""
    transition = np.full((states, states), 0.2 / (states - 1))
    np.fill_diagonal(transition, 0.8)
    ramp = np.array([[1 + (v + 4 * k) % symbols for v in range(symbols)] for k in range(states)], dtype=float)
    return Parameters(np.full(states, 1.0 / states), transition, ramp / ramp.sum(1, keepdims=True))


class Packed:
    """Sequences laid out step by step without padding.

    Sequences are ranked from long to short, so those that still run at a step are the first
    ``live[t]`` of them, and the flat arrays hold step 0 of all, then step 1 of all that have one,
    and so on: rows ``offset[t]`` to ``offset[t + 1]`` belong to step t.
    """

    def __init__(self, sequences: list[np.ndarray]) -> None:
        lengths = np.fromiter((len(s) for s in sequences), dtype=np.int64, count=len(sequences))
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        steps = int(sizes[0]) if len(sizes) else 0
        self.live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")
        self.offset = np.r_[0, np.cumsum(self.live)]
        self.rank = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        #: where each token, sequences end to end in rank order, stands in the flat arrays
        self.slot = self.offset[step] + self.rank
        self.sizes = sizes
        self.y = self.lay([sequences[i] for i in self.order], np.int64)

    @classmethod
    def read(cls, live: np.ndarray, y: np.ndarray) -> Packed:
        """Of a row of :func:`laid`: steps and symbols, without the way back to the sequences."""
        pack = cls.__new__(cls)
        pack.live, pack.y, pack.offset = live, y.astype(np.int64), np.r_[0, np.cumsum(live)]
        return pack

    def lay(self, ranked: list[np.ndarray], kind: type) -> np.ndarray:
        """Flat array of values given for each sequence in rank order."""
        out = np.empty(len(self.slot), dtype=kind)
        if ranked:
            out[self.slot] = np.concatenate(ranked)
        return out

    def rows(self, t: int, most: int | None = None) -> slice:
        n = self.live[t] if most is None else min(most, self.live[t])
        return slice(self.offset[t], self.offset[t] + n)

    def sums(self, flat: np.ndarray) -> np.ndarray:
        """Sum over each sequence, in the order given at first."""
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.rank, flat[self.slot], len(self.order))
        return out

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        """Values of each sequence, in the order given at first."""
        parts = np.split(flat[self.slot], np.cumsum(self.sizes)[:-1])
        out: list[np.ndarray] = [np.empty(0, flat.dtype)] * len(parts)
        for rank, i in enumerate(self.order):
            out[i] = parts[rank]
        return out


def packs(sequences: list[np.ndarray], states: int, cells: int = 4_000_000) -> Iterator[tuple[int, Packed]]:
    """Consecutive sequences together, about ``cells`` tokens times states a pack: (first index, pack)."""
    begin, total = 0, 0
    for i, s in enumerate(sequences):
        if total and (total + len(s)) * states > cells:
            yield begin, Packed(sequences[begin:i])
            begin, total = i, 0
        total += len(s)
    if begin < len(sequences):
        yield begin, Packed(sequences[begin:])


def table(of_symbols: np.ndarray, pack: Packed) -> np.ndarray:
    """Rows by symbol, from which those of a step are taken without a check of each; all symbols are checked here."""
    if len(pack.y) and not 0 <= pack.y.min() <= pack.y.max() < len(of_symbols):
        raise IndexError(f"a symbol is none of {len(of_symbols)}")
    return np.ascontiguousarray(of_symbols)


def filtered(p: Parameters, pack: Packed) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities at every step given the past, and the probability of each symbol given the past."""
    emission, ones = table(p.emission.T, pack), np.ones(len(p.initial))
    alpha, scale = np.empty((len(pack.y), len(ones))), np.empty(len(pack.y))
    chance = np.empty((pack.live[0] if len(pack.live) else 0, len(ones)))
    for t in range(len(pack.live)):
        here, of_symbol = pack.rows(t), chance[: pack.live[t]]
        now, total = alpha[here], scale[here]
        if t:
            np.matmul(alpha[pack.rows(t - 1, pack.live[t])], p.transition, out=now)
        else:
            now[:] = p.initial
        now *= emission.take(pack.y[here], 0, of_symbol, "clip")
        np.maximum(np.matmul(now, ones, out=total), TINY, out=total)
        now /= total[:, None]
    return alpha, scale


def expectations(p: Parameters, pack: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected initial, transition and emission counts and the log likelihood of a pack.

    ``ahead`` is the evidence of the symbols still to come; one step back is folded into the
    transition counts at once, so only two steps of it are ever held besides the posteriors.
    """
    states, symbols = p.emission.shape
    posterior, scale = filtered(p, pack)
    emission, back, known = table(p.emission.T, pack), np.ascontiguousarray(p.transition.T), np.eye(symbols)
    moves, emitted = np.zeros((states, states)), np.zeros((symbols, states))
    most, goes_on = pack.live[0] if len(pack.live) else 0, 0
    ahead, seen, marks = np.empty((most, states)), np.empty((most, states)), np.empty((most, symbols))
    for t in range(len(pack.live) - 1, -1, -1):
        here, n = pack.rows(t), pack.live[t]
        now, posteriors, y = ahead[:n], posterior[here], pack.y[here]
        if goes_on:
            moves += posteriors[:goes_on].T @ seen[:goes_on]
            np.matmul(seen[:goes_on], back, out=now[:goes_on])
        now[goes_on:] = 1
        posteriors *= now
        emitted += known.take(y, 0, marks[:n], "clip").T @ posteriors
        if t:
            emission.take(y, 0, seen[:n], "clip")
            seen[:n] *= now
            seen[:n] /= scale[here, None]
        goes_on = n
    first = posterior[pack.rows(0)].sum(0) if len(pack.live) else np.zeros(states)
    return first, moves * p.transition, emitted.T, float(np.log(scale).sum())


def arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(t, dtype=np.int64) for t in column]


#: Tokens of a row of :func:`laid`; with few hundred sequences a row, a step works on enough of them at once.
PACK = 60_000
LAID = [("keys", np.int64), ("live", np.int32), ("y", np.int32)]


def laid(tokens: DataFrame, most: int = PACK) -> DataFrame:
    """Sequences packed as they are worked on, about ``most`` tokens a row, those of like lengths together.

    Every sequence has a key from its ``piece_id``, if there is one, for numbers drawn for it. Rows
    are spread evenly over the cores. What is laid already stays as it is.
    """
    if tokens.columns == [name for name, _ in LAID]:
        return tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, (flat, ends) = batch["key"].to_numpy(zero_copy_only=False), flattened(batch["tokens"])
            order = np.argsort(np.diff(ends), kind="stable")
            for _, pack in packs([flat[ends[i] : ends[i + 1]] for i in order], 1, most):
                ranked, order = order[: len(pack.order)][pack.order], order[len(pack.order) :]
                values = [keys[ranked], pack.live, pack.y]
                yield pa.RecordBatch.from_arrays([pa.array([v.astype(kind).tobytes()]) for v, (_, kind) in zip(values, LAID)], [name for name, _ in LAID])

    key = F.xxhash64("piece_id") if "piece_id" in tokens.columns else F.lit(0).cast("long")
    rows = tokens.select(key.alias("key"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, ", ".join(f"{name} binary" for name, _ in LAID))
    return rows.repartition(tokens.sparkSession.sparkContext.defaultParallelism)


def flattened(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists end to end, and where each begins and the last ends."""
    ends = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), ends


@contextmanager
def kept(tokens: DataFrame, most: int = PACK) -> Iterator[DataFrame]:
    """Sequences laid, and cached as long as iterations go over them; who laid them before keeps them."""
    rows = laid(tokens, most)
    if rows is tokens:
        yield rows
        return
    rows = rows.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def summed(tokens: DataFrame, of_pack: Callable[[Packed, np.ndarray], list[np.ndarray]]) -> list[np.ndarray] | None:
    """Arrays made of each pack and its keys, summed: one row a task comes to the driver. None without sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in zip(*(batch[name].to_pylist() for name, _ in LAID)):
                keys, live, y = (np.frombuffer(x, kind) for x, (_, kind) in zip(row, LAID))
                found = of_pack(Packed.read(live, y), keys)
                total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, dtype=np.float64).tobytes()]) for x in total], [f"a{i}" for i in range(len(total))])

    shapes = [np.shape(x) for x in of_pack(Packed([]), np.empty(0, np.int64))]
    rows = laid(tokens).mapInArrow(run, ", ".join(f"a{i} binary" for i in range(len(shapes)))).collect()
    return [sum(np.frombuffer(r[i]).reshape(shape) for r in rows) for i, shape in enumerate(shapes)] if rows else None


def expected_counts(tokens: DataFrame, p: Parameters) -> list[np.ndarray] | None:
    """Expected initial, transition and emission counts and the log likelihood of the corpus; None without sequences."""
    return summed(tokens, lambda pack, keys: list(expectations(p, pack)))


def fit(tokens: DataFrame, states: int, symbols: int, iterations: int = 10, smoothing: float = 1e-3, tolerance: float = 1e-4, seed: int = 0) -> tuple[Parameters, list[float]]:
    """Baum-Welch; returns the parameters and the log likelihood before each update."""
    p, history = Parameters.start(states, symbols, seed), []
    with kept(tokens) as rows:
        for _ in range(iterations):
            counts = expected_counts(rows, p)
            if counts is None:
                break
            history.append(float(counts[3]))
            p = maximised(counts, smoothing)
            if len(history) > 1 and abs(history[-1] - history[-2]) <= tolerance * abs(history[-2]):
                break
    return p, history


def maximised(counts: list[np.ndarray], smoothing: float) -> Parameters:
    """The parameters that expected counts make likeliest."""
    first, moves, emitted = (x + smoothing for x in counts[:3])
    return Parameters(first / first.sum(), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(1, keepdims=True))


def begun(tokens: DataFrame, bos: int) -> DataFrame:
    """Whole sequences after the start symbol, as models are fitted to them."""
    return tokens.select("piece_id", F.concat(F.array(F.lit(bos)), "tokens").alias("tokens"))


def begun_slices(tokens: DataFrame, bos: int, length: int) -> DataFrame:
    """Slices of ``length`` tokens, each after the start symbol, as models are scored on them; every token stands in one."""
    starts = F.sequence(F.lit(1), F.size("tokens"), F.lit(length))
    cut = tokens.where(F.size("tokens") > 0).withColumn("start", F.explode(starts))
    return cut.select("piece_id", F.concat(F.array(F.lit(bos)), F.slice("tokens", F.col("start"), F.lit(length))).alias("tokens"))


def conditional_scores(slices: DataFrame, p: Parameters, bos: int) -> DataFrame:
    """``(piece_id, n, ll)`` of each piece given the start symbol of its slices, which isn't scored itself."""
    known = float(np.log(max((p.initial * p.emission[:, bos]).sum(), TINY)))
    per = log_likelihoods(slices, p)
    return per.groupBy("piece_id").agg(F.sum(F.col("n") - 1).cast("int").alias("n"), F.sum(F.col("ll") - known).alias("ll"))


def held_out_nll(slices: DataFrame, p: Parameters, bos: int) -> float:
    """Negative log likelihood a token; every slice begins with the start symbol, which isn't scored."""

    def of_pack(pack: Packed, keys: np.ndarray) -> list[np.ndarray]:
        log = np.log(filtered(p, pack)[1])[pack.live[0] if len(pack.live) else 0 :]
        return [np.float64(len(log)), log.sum()]

    n, ll = summed(slices, of_pack) or (0, 0.0)
    return -float(ll) / max(1, float(n))


def fit_validated(
    train: DataFrame, validation: DataFrame, p: Parameters, bos: int, iterations: int = 100, smoothing: float = 1e-3, tolerance: float = 1e-4
) -> tuple[Parameters, float, list[tuple[float, float]]]:
    """Baum-Welch on ``begun`` sequences, kept by the NLL of the ``begun_slices`` of the validation pieces.

    After each update the validation NLL is taken. The parameters of the last update that
    betters it by more than ``tolerance`` are returned with their NLL; the first that is within
    ``tolerance`` of the best without doing so ends the fit. The history holds the train log
    likelihood before, and the validation NLL after each update. While that is taken, the counts of
    the next update are begun; those of one that isn't made are dropped.
    """
    best, least, history = p, float("inf"), []
    with kept(train) as train, kept(validation) as validation, ThreadPoolExecutor(1) as aside:
        begun_counts = aside.submit(expected_counts, train, p)
        for i in range(iterations):
            counts = begun_counts.result()
            if counts is None:
                break
            p = maximised(counts, smoothing)
            if i + 1 < iterations:
                begun_counts = aside.submit(expected_counts, train, p)
            nll = held_out_nll(validation, p, bos)
            history.append((float(counts[3]), nll))
            if nll + tolerance < least:
                best, least = p, nll
            elif abs(nll - least) <= tolerance:
                break
    return best, least, history


def fit_grid(
    train: DataFrame, validation: DataFrame, grid: tuple[int, ...], symbols: int, bos: int, iterations: int = 100, tolerance: float = 1e-4, seed: int = 0
) -> tuple[int, Parameters, dict[int, tuple[float, list[tuple[float, float]]]]]:
    """One fit for each number of states: the number with the least validation NLL, its parameters, and the NLL and history of all.

    The fits don't depend on each other and run side by side, so the jobs of one fill the cores between those of another.
    """
    rng = np.random.default_rng(seed)
    starts = [Parameters.start(states, symbols, int(rng.integers(0, 2**32 - 1)), 1.0) for states in grid]
    with kept(train) as train, kept(validation) as validation, ThreadPoolExecutor(len(grid)) as pool:
        done = list(pool.map(lambda start: fit_validated(train, validation, start, bos, iterations, tolerance=tolerance), starts))
    fits, log = {k: p for k, (p, _, _) in zip(grid, done)}, {k: (least, history) for k, (_, least, history) in zip(grid, done)}
    best = min(grid, key=lambda k: log[k][0])
    return best, fits[best], log


def log_likelihoods(tokens: DataFrame, p: Parameters, *keys: str) -> DataFrame:
    """``(piece_id, *keys, n, ll)``: scaled forward likelihood for any number of states; an empty sequence has 0."""
    keep = ["piece_id", *keys]
    schema = tokens.select(*keep).schema.add("n", "integer").add("ll", "double")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ll = np.zeros(len(part))
            for at, pack in packs(arrays(part["tokens"]), len(p.initial)):
                ll[at : at + len(pack.order)] = pack.sums(np.log(filtered(p, pack)[1]))
            yield part[keep].assign(n=part["tokens"].map(len).astype("int32"), ll=ll)

    return tokens.select(*keep, "tokens").mapInPandas(run, schema)


class Relations:
    """Scores of best moves where log transitions depend on few relations between the states.

    ``masks`` are relations (K x K, from i to j). Each counts with the least value that a row of
    ``log`` takes in it, so it never counts too much; together they must give every entry of
    ``log`` exactly, so the best over the relations is the best over all moves, to the last bit.
    States that stand in a relation to the same states are compared once.
    """

    def __init__(self, log: np.ndarray, masks: list[np.ndarray]) -> None:
        self.terms, given = [], np.full(log.shape, -np.inf)
        for mask in masks:
            low = np.where(mask, log, np.inf).min(1)
            given = np.where(mask, np.maximum(given, low[:, None]), given)
            kinds, of_row = np.unique(mask, axis=0, return_inverse=True)
            kept = np.flatnonzero(kinds.any(1))
            sources = self.padded([np.flatnonzero(of_row == k) for k in kept])
            wanted, of_column = np.unique(kinds[kept], axis=1, return_inverse=True)
            some = np.flatnonzero(wanted.any(0))
            place = np.full(wanted.shape[1], -1)
            place[some] = np.arange(len(some))
            to = np.flatnonzero(place[of_column] >= 0)
            self.terms.append((sources, low[sources][:, :, None], self.padded([np.flatnonzero(wanted[:, k]) for k in some]), to, place[of_column][to]))
        if not np.array_equal(given, log):
            raise ValueError("the relations don't give the transitions")

    @staticmethod
    def padded(groups: list[np.ndarray]) -> np.ndarray:
        """One group a row, its first member repeated to the length of the longest."""
        return np.array([np.r_[g, np.repeat(g[:1], max(map(len, groups)) - len(g))] for g in groups])

    def best(self, score: np.ndarray, wide: int = 256) -> np.ndarray:
        """For scores of states (K x n) those of the best moves to every state (K x n); ``wide`` columns at once."""
        out = np.full(score.shape, -np.inf)
        for at in range(0, score.shape[1], wide):
            here, best = np.ascontiguousarray(score[:, at : at + wide]), np.full((len(score), min(wide, score.shape[1] - at)), -np.inf)
            for sources, low, targets, to, place in self.terms:
                of_group = (here[sources] + low).max(1)
                reached = of_group[targets].max(1) if targets.shape[1] > 1 else of_group[targets[:, 0]]
                if len(to) == len(best):
                    np.maximum(best, reached[place], out=best)
                else:
                    best[to] = np.maximum(best[to], reached[place])
            out[:, at : at + wide] = best
        return out


def log_floor(m: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(m, TINY))


def best_paths(p: Parameters, pack: Packed, relations: Relations | None = None) -> np.ndarray:
    """Likeliest state at every row of a pack; of equals the lowest.

    Only scores are kept; where a state of the path came from is found again on the way back, for
    that state alone. ``relations`` of the log transitions save work and change no result.
    """
    move, emit = log_floor(p.transition), log_floor(p.emission)
    come, states = np.ascontiguousarray(move.T)[None], len(p.initial)
    score = log_floor(p.initial)[:, None] + emit[:, pack.y[pack.rows(0)]]
    final = [score]
    wide = max(1, 4_000_000 // states**2)
    for t in range(1, len(pack.live)):
        here, before = pack.rows(t), score[:, : pack.live[t]]
        if relations:
            fresh = relations.best(before)
        else:
            fresh = np.empty(before.shape)
            for i in range(0, pack.live[t], wide):
                fresh[:, i : i + wide] = (before[:, i : i + wide].T[:, None, :] + come).max(2).T  # row x to x from
        score = fresh + emit[:, pack.y[here]]
        final.append(score)
    path = np.empty(len(pack.y), dtype=np.int32)
    for t in range(len(pack.live) - 1, -1, -1):
        here = pack.rows(t)
        goes_on = pack.live[t + 1] if t + 1 < len(pack.live) else 0
        if goes_on:
            path[here.start : here.start + goes_on] = (final[t][:, :goes_on] + move[:, path[pack.rows(t + 1)]]).argmax(0)
        path[here.start + goes_on : here.stop] = final[t][:, goes_on:].argmax(0)
    return path


def viterbi(tokens: DataFrame, p: Parameters, relations: Relations | None = None) -> DataFrame:
    """``(piece_id, t, state)``: the likeliest path of each sequence, the lowest state of equals."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, sequences = part["piece_id"].to_numpy(), arrays(part["tokens"])
            even = np.argsort([len(s) for s in sequences], kind="stable")  # sequences of a pack end together
            ids, sequences = ids[even], [sequences[i] for i in even]
            for at, pack in packs(sequences, len(p.initial), 8_000_000):
                n = np.zeros(len(pack.order), dtype=np.int64)
                n[pack.order] = pack.sizes
                states = pack.split(best_paths(p, pack, relations)) if len(pack.y) else []
                yield pd.DataFrame(
                    {
                        "piece_id": np.repeat(ids[at : at + len(n)], n),
                        "t": (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32),
                        "state": np.concatenate([*states, np.empty(0, np.int32)]),
                    }
                )

    return tokens.select("piece_id", "tokens").mapInPandas(run, "piece_id string, t int, state int")


def drawn_paths(p: Parameters, pack: Packed, uniform: np.ndarray) -> np.ndarray:
    """A state path of each sequence from its posterior: filtered forward, drawn backward, one uniform number a row."""
    alpha, _ = filtered(p, pack)
    path = np.empty(len(pack.y), dtype=np.int64)
    back, up_to = np.ascontiguousarray(p.transition.T), np.triu(np.ones(p.transition.shape))
    moved = np.empty((pack.live[0] if len(pack.live) else 0, len(back)))
    for t in range(len(pack.live) - 1, -1, -1):
        here, weight = pack.rows(t), alpha[pack.rows(t)]
        if t + 1 < len(pack.live):
            weight[: pack.live[t + 1]] *= back.take(path[pack.rows(t + 1)], 0, moved[: pack.live[t + 1]], "clip")
        mass = weight @ up_to
        beyond = mass > uniform[here, None] * mass[:, -1:]
        beyond[:, -1] = True
        path[here] = beyond.argmax(1)
    return path


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_numbers(keys: np.ndarray, pack: Packed, seed: int) -> np.ndarray:
    """A uniform number for every row of a pack, by SplitMix64 from the key of its sequence and the seed, so tasks may be repeated."""
    begin = mixed(keys.view(np.uint64) ^ mixed(np.array([seed], dtype=np.uint64)))
    step = np.repeat(np.arange(len(pack.live)), pack.live)
    rank = np.arange(len(pack.y)) - pack.offset[step]
    return (mixed(begin[rank] + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53


def path_counts(p: Parameters, pack: Packed, z: np.ndarray) -> list[np.ndarray]:
    """First states, moves and emissions of paths of a pack."""
    states, symbols = p.emission.shape
    first = int(pack.live[0]) if len(pack.live) else 0
    before = np.arange(first, len(z)) - np.repeat(pack.live[:-1], pack.live[1:])
    moves = np.bincount(z[before] * states + z[first:], minlength=states * states)
    emitted = np.bincount(z * symbols + pack.y, minlength=states * symbols)
    return [np.bincount(z[:first], minlength=states), moves.reshape(states, states), emitted.reshape(states, symbols)]


def halves(pack: Packed) -> tuple[Packed, Packed]:
    """The even steps of a pack, and the odd ones."""
    steps = [pack.y[pack.rows(t)] for t in range(len(pack.live))]
    even, odd = (Packed.read(pack.live[i::2], np.concatenate([*steps[i::2], np.empty(0, np.int64)])) for i in (0, 1))
    return even, odd


def relative(emission: np.ndarray) -> np.ndarray:
    """Rows by symbol as parts of their largest: a factor of a symbol changes no path."""
    return emission / np.maximum(emission.max(1, keepdims=True), TINIEST)


def drawn_evens(p: Parameters, even: Packed, odd: Packed, uniform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States at the even steps of paths from the posterior, one uniform number a row, and what follows each.

    The states of odd steps are summed over; given those beside them they depend on nothing else, so
    they may be drawn later. What follows is numbered: symbol of the odd step times states plus the
    state after it; after all these the symbol of a last odd step; then the end.
    """
    states, symbols = p.emission.shape
    emission, ones, up_to = table(p.emission.T, even), np.ones(states), np.triu(np.ones((states, states)))
    table(emission, odd)
    emission = relative(emission)
    onward = (p.transition * emission[:, None]) @ p.transition
    ahead = np.concatenate([onward.swapaxes(1, 2).reshape(-1, states), emission @ p.transition.T, ones[None]])
    live, at, odd_live, odd_at = (x.tolist() for x in (even.live, even.offset, odd.live, odd.offset))
    most, last = live[0] if live else 0, len(ahead) - 1
    alpha, follows, z = np.empty((len(even.y), states)), np.empty(len(even.y), np.int64), np.empty(len(even.y), np.int64)
    one, other, beyond = np.empty((most, states)), np.empty((most, states)), np.empty((most, states), bool)
    for t, n in enumerate(live):
        now = alpha[at[t] : at[t + 1]]
        if t:
            between = alpha[at[t - 1] : at[t - 1] + n].dot(p.transition, one[:n])
            between *= emission.take(odd.y[odd_at[t - 1] : odd_at[t - 1] + n], 0, other[:n], "clip")
            between.dot(p.transition, now)
        else:
            now[:] = p.initial
        now *= emission.take(even.y[at[t] : at[t + 1]], 0, other[:n], "clip")
        if t % 4 == 0:
            now /= np.maximum(now.dot(ones), TINIEST)[:, None]
    for t in range(len(live) - 1, -1, -1):
        here, n = slice(at[t], at[t + 1]), live[t]
        moves, goes_on = (x[k] if k < len(x) else 0 for x, k in ((odd_live, t), (live, t + 1)))
        after, symbol = follows[here], odd.y[odd_at[t] : odd_at[t] + moves] if moves else odd.y[:0]
        np.multiply(symbol[:goes_on], states, out=after[:goes_on])
        after[:goes_on] += z[at[t + 1] : at[t + 1] + goes_on]
        np.add(symbol[goes_on:], symbols * states, out=after[goes_on:moves])
        after[moves:] = last
        weight = ahead.take(after, 0, one[:n], "clip")
        weight *= alpha[here]
        mass = weight.dot(up_to, other[:n])
        np.greater(mass, (uniform[here] * mass[:, -1])[:, None], out=beyond[:n])
        beyond[:n, -1] = True
        beyond[:n].argmax(1, z[here])
    return z, follows


def even_counts(p: Parameters, even: Packed, z: np.ndarray, follows: np.ndarray) -> list[np.ndarray]:
    """First states, emissions of even steps, and how often a number of :func:`drawn_evens` follows a state."""
    states, symbols = p.emission.shape
    first, kinds = int(even.live[0]) if len(even.live) else 0, symbols * states + symbols + 1
    emitted = np.bincount(z * symbols + even.y, minlength=states * symbols)
    after = np.bincount(z * kinds + follows, minlength=states * kinds)
    return [np.bincount(z[:first], minlength=states), emitted.reshape(states, symbols), after.reshape(states, kinds)]


def filled(p: Parameters, counts: list[np.ndarray], rng: np.random.Generator) -> list[np.ndarray]:
    """First states, moves and emissions of whole paths: the states of odd steps are drawn for all that stand alike at once."""
    first, emitted, after = (np.rint(x).astype(np.int64) for x in counts)
    states, symbols = p.emission.shape
    i, follows = np.nonzero(after[:, :-1])
    inner = follows < symbols * states
    symbol, j = np.where(inner, follows // states, follows - symbols * states), follows % states
    weight = p.transition[i] * relative(p.emission.T)[symbol]
    weight[inner] *= p.transition.T[j[inner]]
    total = weight.sum(1, keepdims=True)
    middle = rng.multinomial(after[i, follows], np.where(total > 0, weight, 1) / np.where(total > 0, total, states))
    moves = np.zeros((states, states), np.int64)
    np.add.at(moves, i, middle)
    np.add.at(moves.T, j[inner], middle[inner])
    np.add.at(emitted.T, symbol, middle)
    return [first, moves, emitted]


#: Cells of the counts of :func:`even_counts` up to which states are drawn at even steps first; tokens of a row for that.
FEW, EVENS_PACK = 1 << 17, 120_000


def drawn_counts(rows: DataFrame, p: Parameters, seed: int, rng: np.random.Generator) -> list[np.ndarray] | None:
    """First states, moves and emissions of a path of every sequence from its posterior; None without sequences."""
    states, symbols = p.emission.shape
    if symbols * states**2 > FEW:
        return summed(rows, lambda pack, keys: path_counts(p, pack, drawn_paths(p, pack, drawn_numbers(keys, pack, seed))))

    def of_pack(pack: Packed, keys: np.ndarray) -> list[np.ndarray]:
        even, odd = halves(pack)
        return even_counts(p, even, *drawn_evens(p, even, odd, drawn_numbers(keys, even, seed)))

    counts = summed(rows, of_pack)
    return counts and filled(p, counts, rng)


def drawn_in_packs(ids: list[str], sequences: list[np.ndarray], p: Parameters, seed: int) -> Iterator[tuple[int, Packed, np.ndarray]]:
    """(first index, pack, path at every row); numbers come from each piece's own seed, so tasks may be repeated."""
    for at, pack in packs(sequences, len(p.initial)):
        numbers = [np.random.default_rng(piece_seed(ids[at + i], seed)).random(len(sequences[at + i])) for i in pack.order]
        yield at, pack, drawn_paths(p, pack, pack.lay(numbers, np.float64))


def piece_seed(piece_id: str, seed: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.md5(f"{seed}:{piece_id}".encode()).digest()[:8], "big")


def backward_samples(tokens: DataFrame, p: Parameters, seed: int) -> DataFrame:
    """``(piece_id, states)``: one posterior path a piece."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, paths = part["piece_id"].tolist(), []
            for _, pack, path in drawn_in_packs(ids, arrays(part["tokens"]), p, seed):
                paths += [x.tolist() for x in pack.split(path)]
            yield pd.DataFrame({"piece_id": part["piece_id"], "states": paths})

    return tokens.select("piece_id", "tokens").mapInPandas(run, "piece_id string, states array<int>")


def table_count(n: np.ndarray, a: np.ndarray, rng: np.random.Generator, chunk: int = 1 << 20) -> np.ndarray:
    """Tables of n customers with concentration a (arrays of one shape, or numbers), exact in law at every n.

    Customer i opens a table with chance a / (a + i). The first ones are drawn singly, about ``chunk``
    at once. Later ones seldom do, so of each doubling block those are drawn who would at the
    block's largest chance, a few places without repeats, and each is kept by its own chance over that.
    """
    shape = np.broadcast_shapes(np.shape(n), np.shape(a))
    n, a = (np.broadcast_to(x, shape).ravel() for x in (np.asarray(n, dtype=np.int64), np.asarray(a, dtype=float)))
    out, singly = np.zeros(len(n), dtype=np.int64), int(max(64, np.ceil(a.max(initial=0.0)) ** 2))
    begin, wide = 0, max(1, chunk // max(1, len(n)))
    while begin < min(singly, n.max(initial=0)):
        i = np.arange(begin, min(begin + wide, singly))
        out += ((rng.random((len(n), len(i))) * (a[:, None] + i) < a[:, None]) & (i < n[:, None])).sum(1)
        begin += len(i)
    while begin < n.max(initial=0):
        cells = np.flatnonzero(n > begin)
        size, most = np.minimum(n[cells], 2 * begin) - begin, a[cells] / (a[cells] + begin)
        cell = np.repeat(np.arange(len(cells)), rng.binomial(size, most))
        place = rng.integers(0, size[cell])
        while True:
            order = np.lexsort((place, cell))
            twice = cell[order[1:]][(np.diff(cell[order]) == 0) & (np.diff(place[order]) == 0)]
            if not len(twice):
                break
            again = np.isin(cell, twice)
            place[again] = rng.integers(0, size[cell[again]])
        opened = rng.random(len(cell)) * most[cell] * (a[cells][cell] + begin + place) < a[cells][cell]
        out += np.bincount(cells[cell[opened]], minlength=len(n))
        begin *= 2
    return out.reshape(shape)


def gibbs_grid(
    train: DataFrame, validation: DataFrame, grid: tuple[tuple[float, float, float], ...], states: int, symbols: int, bos: int, iterations: int, burn_in: int, seed: int
) -> tuple[int, Parameters, list[tuple[float, list[dict]]]]:
    """A chain for each (alpha, alpha of first states, gamma), without stickiness: the one of least validation NLL, its posterior mean, and the NLL and trace of all.

    The chains run side by side.
    """
    with kept(train, EVENS_PACK) as train, kept(validation) as validation, ThreadPoolExecutor(len(grid)) as pool:

        def chain(i: int) -> tuple[float, list[dict], Parameters]:
            alpha, initial, gamma = grid[i]
            p, trace = gibbs(train, states, symbols, iterations, alpha, gamma, 0.0, 1.0 / symbols, seed + i, initial, burn_in)
            return held_out_nll(validation, p, bos), trace, p

        out = list(pool.map(chain, range(len(grid))))
    best = min(range(len(grid)), key=lambda i: out[i][0])
    return best, out[best][2], [(nll, trace) for nll, trace, _ in out]


def gibbs(
    tokens: DataFrame, states: int, symbols: int, iterations: int = 10, alpha: float = 4.0, gamma: float = 3.0, kappa: float = 10.0, rho: float = 0.5, seed: int = 0,
    alpha_initial: float | None = None, burn_in: int | None = None,
) -> tuple[Parameters, list[dict]]:
    """Truncated sticky HDP-HMM by blocked Gibbs: paths are sampled where the pieces are (see :func:`drawn_counts`), counts are summed, parameters drawn on the driver.

    The shared weights are drawn from the numbers of tables of a Chinese restaurant franchise.
    ``alpha_initial`` weighs the shared weights for first states (default ``alpha``). Returns the
    mean of the parameters from iteration ``burn_in`` on (default the later half) and a trace with
    the log likelihood, the active states and the entropy of the weights of each iteration.
    """
    alpha_initial = alpha if alpha_initial is None else alpha_initial
    burn_in = iterations // 2 if burn_in is None else burn_in
    rng = np.random.default_rng(seed)
    sticks = rng.beta(1.0, gamma, states)
    beta = sticks * np.r_[1.0, np.cumprod(1 - sticks)[:-1]]
    beta /= beta.sum()
    p = Parameters.start(states, symbols, seed)
    trace, samples = [], []
    with kept(tokens, EVENS_PACK) as rows:
        for it in range(iterations):
            counts = drawn_counts(rows, p, seed * 10_007 + it, rng)
            if counts is None:
                break
            first, moves, emitted = counts
            ll = float((moves * log_floor(p.transition)).sum() + (emitted * log_floor(p.emission)).sum())
            tables = table_count(moves.round(), alpha * beta + kappa * np.eye(states), rng)
            own = rng.binomial(np.diag(tables), kappa / (kappa + alpha * np.maximum(beta, TINY)))
            shared = tables - np.diag(own)
            beta = rng.dirichlet(gamma / states + shared.sum(0))
            transition = np.stack([rng.dirichlet(np.maximum(alpha * beta + kappa * (np.arange(states) == i) + moves[i], TINY)) for i in range(states)])
            emission = np.stack([rng.dirichlet(rho + emitted[i]) for i in range(states)])
            p = Parameters(rng.dirichlet(np.maximum(alpha_initial * beta, TINY) + first), transition, emission)
            trace.append({"iteration": it, "log_likelihood": ll, "active_states": int((emitted.sum(1) > 0).sum()), "beta_entropy": float(-(beta * np.log(beta + TINY)).sum())})
            if it >= burn_in:
                samples.append(p)
    if samples:
        p = Parameters(*(np.mean([getattr(x, f) for x in samples], axis=0) for f in ("initial", "transition", "emission")))
    return p, trace


def initial_states(rows: DataFrame, symbol: str, active: int, states: int, symbols: int, seed: int, *key: str) -> DataFrame:
    """``rows`` with ``state``: symbols in order round the active states, a tenth of the rows anywhere among them.

    The numbers come from hashes of the key, so tasks may be repeated. The symbols that occur are
    a vocabulary of at most ``symbols`` rows.
    """
    active = max(2, min(active, states, max(2, min(symbols, states))))
    order = rows.select(symbol).distinct().withColumn("i", F.dense_rank().over(Window.orderBy(symbol)) - 1)
    names = [F.col(k).cast("string") for k in key]
    noisy = uniform(seed, *names) < 0.1
    anywhere = F.floor(uniform(seed + 1, *names) * active).cast("int")
    return rows.join(F.broadcast(order), symbol).withColumn("state", F.when(noisy, anywhere).otherwise((F.col("i") % active).cast("int"))).drop("i")
