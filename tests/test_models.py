"""Sequence models against literal values and naive versions."""

import itertools
import math
import threading
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scorelake.operators import harmony as H
from scorelake.operators import hidden_markov as HM
from scorelake.operators import markov as V
from scorelake.plans import models as M


def tokens(spark, *sequences):
    return spark.createDataFrame([(f"p{k}", t, x) for k, s in enumerate(sequences) for t, x in enumerate(s)], "piece_id string, t int, token int")


def test_back_off_markov(spark):
    counts = V.fit(tokens(spark, [0, 1, 0], [0, 1, 0]), 2, 2)
    asked = spark.createDataFrame([([1],), ([1, 1],), ([],), ([0, 1],)], "context array<int>")
    p = {tuple(r["context"]): r["p"] for r in V.distributions(asked, V.contexts(counts), 3).collect()}
    assert math.isclose(p[1,][0], 71 / 105) and math.isclose(p[()][0], 3 / 5) and math.isclose(p[0, 1][0], 221 / 315)
    assert np.allclose(p[1, 1], [71 / 105, 13 / 63, 37 / 315])
    assert counts.count() == 7


def test_order_selection(spark):
    train, validation = tokens(spark, [0, 1, 0], [0, 1, 0]), tokens(spark, [0, 1, 0])
    rows = {r["depth"]: (r["nll"], r["cells"]) for r in V.select_order(train, validation, [0, 1], 2, 3).collect()}
    assert rows[1][1] == 5 and math.isclose(rows[1][0], -math.log(71 / 105 * 37 / 63 * 71 / 105) / 3, abs_tol=1e-6) and rows[1][0] < rows[0][0]


def test_orders_do_not_pile_up_in_one_plan(spark):
    train, validation = tokens(spark, [0, 1, 0], [0, 1, 0]), tokens(spark, [0, 1, 0])
    plan = V.select_order(train, validation, [0, 1, 2], 2, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Window" not in plan


def test_orders_are_scored_without_whole_distributions(spark, monkeypatch):
    rng, orders = np.random.default_rng(5), [0, 1, 2, 4, 8]
    draw = lambda n: [[int(x) for x in rng.choice(6, k, p=[0.5, 0.3, 0.1, 0.05, 0.04, 0.01])] for k in n]
    train, validation = tokens(spark, *draw((40, 1, 9, 0, 70)), [9, 0, 0, 9]), tokens(spark, *draw((33, 1, 12)), [0, 0, 9, 5, 9, 0, 0])  # 9 is no symbol
    counts = V.fit(train, 8, 5)
    cells = [counts.where(F.col("k") <= d).count() for d in orders]
    nlls = [V.evaluate(V.score(validation, counts.where(F.col("k") <= d), d, 5, 8)).first()["nll"] for d in orders]
    monkeypatch.setattr(V, "distributions", None)
    rows = V.select_order(train, validation, orders, 5, 8).collect()
    assert [r["depth"] for r in rows] == orders and [r["cells"] for r in rows] == cells
    assert np.allclose([r["nll"] for r in rows], nlls, atol=2e-6)
    none = V.select_order(train.limit(0), validation, [2], 5, 8).first()
    assert none["cells"] == 0 and V.select_order(train, validation.limit(0), [2], 5, 8).first()["nll"] is None


def test_scores(spark):
    rows = spark.createDataFrame([(0.7, 0, 0, 0.14), (0.1, 1, 2, 1.26), (0.6, 1, 1, 0.46)], "probability double, best int, token int, brier double")
    one = V.evaluate(rows).first()
    assert math.isclose(one["nll"], -math.log(0.042) / 3, abs_tol=1e-6) and math.isclose(one["accuracy"], 2 / 3, abs_tol=1e-6) and math.isclose(one["brier"], 0.62, abs_tol=1e-6)


def test_generation(spark):
    out = V.generate(V.fit(tokens(spark, [0, 1] * 20), 2, 2), spark.createDataFrame([("p", [0])], "piece_id string, tokens array<int>"), 4, 2, 2).first()
    assert out["tokens"] == [0, 1, 0, 1, 0]


def naive_forward(p, y):
    a = np.log(p.initial) + np.log(p.emission[:, y[0]])
    for v in y[1:]:
        a = np.logaddexp.reduce(a[:, None] + np.log(p.transition), axis=0) + np.log(p.emission[:, v])
    return np.logaddexp.reduce(a)


def test_forward_equals_the_log_domain(spark):
    rng, p = np.random.default_rng(0), HM.example_parameters()
    data = [(f"p{n}", rng.integers(0, 12, n).tolist(), n) for n in (1, 2, 17, 263)] + [("none", [], 0)]
    df = spark.createDataFrame(data, "piece_id string, tokens array<int>, slice int")
    rows = {r["piece_id"]: r for r in HM.log_likelihoods(df, p, "slice").collect()}
    for k, y, n in data:
        assert rows[k]["n"] == rows[k]["slice"] == n
        assert math.isclose(rows[k]["ll"], naive_forward(p, y), rel_tol=1e-9) if y else rows[k]["ll"] == 0


def all_paths(p, y):
    """Every state path of a short sequence with its joint probability, by enumeration in the log domain."""
    out = {}
    for path in itertools.product(range(len(p.initial)), repeat=len(y)):
        logp = math.log(p.initial[path[0]]) + sum(math.log(p.emission[z, v]) for z, v in zip(path, y))
        out[path] = math.exp(logp + sum(math.log(p.transition[a, b]) for a, b in zip(path, path[1:])))
    return out


def test_expectations_equal_enumeration():
    rng, p = np.random.default_rng(1), HM.Parameters.start(3, 5, 4)
    sequences = [rng.integers(0, 5, n) for n in (1, 6, 2, 6, 4)]
    first, moves, emitted, total = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0
    for y in sequences:
        paths = all_paths(p, y)
        evidence = sum(paths.values())
        total += math.log(evidence)
        for path, joint in paths.items():
            first[path[0]] += joint / evidence
            for a, b in zip(path, path[1:]):
                moves[a, b] += joint / evidence
            for z, v in zip(path, y):
                emitted[z, v] += joint / evidence
    got = HM.expectations(p, HM.Packed(sequences))
    for want, have in zip((first, moves, emitted, total), got):
        assert np.allclose(want, have, rtol=1e-9)
    none = HM.expectations(p, HM.Packed([]))
    assert none[1].sum() == 0 and none[3] == 0


def test_best_paths_equal_enumeration():
    rng, p = np.random.default_rng(8), HM.Parameters.start(3, 4, 9)
    sequences = [rng.integers(0, 4, n) for n in (3, 6, 1, 5, 6)]
    pack = HM.Packed(sequences)
    for y, path in zip(sequences, pack.split(HM.best_paths(p, pack))):
        paths = all_paths(p, y)
        assert math.isclose(paths[tuple(path)], max(paths.values()), rel_tol=1e-12)
    even = HM.Parameters(np.full(2, 0.5), np.full((2, 2), 0.5), np.full((2, 3), 1 / 3))
    assert all(not x.any() for x in HM.Packed([np.array([0, 1, 2])]).split(HM.best_paths(even, HM.Packed([np.array([0, 1, 2])]))))


def test_drawn_paths_follow_the_posterior():
    p, y = HM.Parameters.start(2, 3, 3), np.array([0, 2, 1])
    paths = all_paths(p, y)
    evidence, n = sum(paths.values()), 20_000
    pack = HM.Packed([y] * n)
    drawn = Counter(tuple(x) for x in pack.split(HM.drawn_paths(p, pack, np.random.default_rng(0).random(3 * n))))
    assert all(abs(drawn[k] / n - v / evidence) < 0.015 for k, v in paths.items())


def test_fit_raises_the_likelihood(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"p{i}", np.repeat(rng.integers(0, 4, 12), 4).tolist()) for i in range(12)], "piece_id string, tokens array<int>")
    p, history = HM.fit(df, 3, 4, iterations=6, tolerance=0.0)
    assert all(b > a for a, b in zip(history, history[1:])) and np.allclose(p.transition.sum(1), 1) and np.allclose(p.emission.sum(1), 1)


def test_fit_keeps_the_best_by_validation(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"p{i}", np.repeat(rng.integers(0, 4, 12), 4).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "piece_id string, tokens array<int>")
    train, held = HM.begun(df.where("piece_id < 'p5'"), 4), HM.begun_slices(df.where("piece_id >= 'p5'"), 4, 10)
    assert sorted(len(r["tokens"]) for r in held.collect()) == sorted([11] * 20 + [9] * 5)
    start = HM.Parameters.start(3, 5, 1, 1.0)
    p, least, history = HM.fit_validated(train, held, start, 4, iterations=8)
    ps = [np.concatenate([[4], np.array(t[a : a + 10])]) for i, t in rows if i >= "p5" for a in range(0, 48, 10)]
    known = math.log((p.initial * p.emission[:, 4]).sum())
    brute = -sum(naive_forward(p, s) - known for s in ps) / sum(len(s) - 1 for s in ps)
    assert math.isclose(least, brute, rel_tol=1e-9) and least <= min(nll for _, nll in history) + 1e-4
    scored = HM.conditional_scores(held, p, 4).collect()
    assert sum(r["n"] for r in scored) == 48 * 5 and math.isclose(-sum(r["ll"] for r in scored) / 240, brute, rel_tol=1e-9)
    # a worsening beyond the tolerance goes on; one that is near the best ends the fit
    for nlls, updates, want in (([3.0, 2.0, 2.5, 1.0, 1.00005, 0.5], 5, 1.0), ([3.0, 4.0, 5.0, 6.0, 7.0, 8.0], 6, 3.0)):
        told = iter(nlls)
        monkeypatch.setattr(HM, "held_out_nll", lambda *a, told=told: next(told))
        _, least, history = HM.fit_validated(train, held, start, 4, iterations=6)
        assert len(history) == updates and least == want
    monkeypatch.setattr(HM, "fit_validated", lambda a, b, start, *c, **d: (start, {2: 1.0, 3: 0.5, 4: 0.7}[len(start.initial)], []))
    assert HM.fit_grid(train, held, (2, 3, 4), 5, 4)[0] == 3


def test_registered_hmm_grid():
    assert (M.HMM_STATES, M.HMM_UPDATES, M.HMM_SLICE) == ((12, 24, 48), 100, 128)


def test_viterbi_and_sampling(spark):
    sharp = HM.Parameters(np.full(3, 1 / 3), np.full((3, 3), 1 / 3), np.full((3, 3), 1e-9) + np.eye(3) * (1 - 3e-9))
    y = [0, 1, 2, 1, 0, 2, 2, 0]
    df = spark.createDataFrame([("p", y), ("q", [])], "piece_id string, tokens array<int>")
    assert [r["state"] for r in HM.viterbi(df, sharp).orderBy("t").collect()] == y
    assert {r["piece_id"]: r["states"] for r in HM.backward_samples(df, sharp, 1).collect()} == {"p": y, "q": []}


def test_gibbs(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"p{i}", np.repeat(rng.integers(0, 3, 10), 5).tolist()) for i in range(10)], "piece_id string, tokens array<int>")
    p, trace = HM.gibbs(df, 5, 3, iterations=6, seed=1)
    assert len(trace) == 6 and trace[-1]["log_likelihood"] > trace[0]["log_likelihood"] and np.allclose(p.transition.sum(1), 1)
    assert HM.gibbs(df, 5, 3, iterations=2, seed=1)[1] == HM.gibbs(df, 5, 3, iterations=2, seed=1)[1]


def test_packs_do_not_change_draws():
    rng, p = np.random.default_rng(5), HM.Parameters.start(6, 5, 2)
    ys = [rng.integers(0, 5, n) for n in (1, 7, 40, 0, 7, 2)]
    ids = [f"p{i}" for i in range(len(ys))]
    alone = [[x.tolist() for _, pack, z in HM.drawn_in_packs([i], [y], p, 3) for x in pack.split(z)] for i, y in zip(ids, ys)]
    together = [x.tolist() for _, pack, z in HM.drawn_in_packs(ids, ys, p, 3) for x in pack.split(z)]
    assert [x[0] for x in alone] == together and [len(x) for x in together] == [len(y) for y in ys]
    assert [at for at, _ in HM.packs(ys, 6, cells=60)] == [0, 2, 3]


def test_table_counts_have_one_law():
    n, a, rng = 6000, 30.0, np.random.default_rng(6)  # the Poisson stand-in has variance 159, the law 129
    q = a / (a + np.arange(n))
    draws = np.array([HM.table_count(n, a, rng, 1 << 12) for _ in range(4000)])
    assert abs(draws.mean() - q.sum()) < 1 and abs(draws.var() / (q * (1 - q)).sum() - 1) < 0.1
    assert HM.table_count(0, a, rng) == 0 and HM.table_count(1, a, rng) == 1


def test_laid_sequences_give_the_counts_of_each(spark):
    rng, p = np.random.default_rng(7), HM.Parameters.start(4, 5, 6)
    ys = [rng.integers(0, 5, n) for n in (3, 9, 1, 0, 9, 40, 2)]
    rows = HM.laid(spark.createDataFrame([(f"p{i}", y.tolist()) for i, y in enumerate(ys)], "piece_id string, tokens array<int>")).cache()
    assert HM.laid(rows) is rows and rows.count() < len(ys)  # an iteration reads few rows, and lays nothing out again
    for got, *want in zip(HM.expected_counts(rows, p), *[HM.expectations(p, HM.Packed([y])) for y in ys]):
        assert np.allclose(got, sum(want), rtol=1e-9)
    assert HM.expected_counts(rows.limit(0), p) is None
    rows.unpersist()


def test_fits_and_chains_run_side_by_side(spark, monkeypatch):
    all_there = threading.Barrier(2, timeout=60)  # breaks if one waits for the other to end
    empty = spark.createDataFrame([], "piece_id string, tokens array<int>")
    monkeypatch.setattr(HM, "fit_validated", lambda a, b, start, *c, **d: (all_there.wait(), (start, float(len(start.initial)), []))[1])
    assert HM.fit_grid(empty, empty, (2, 3), 5, 4)[0] == 2
    monkeypatch.setattr(HM, "gibbs", lambda *a: (all_there.wait(), (HM.example_parameters(), []))[1])
    monkeypatch.setattr(HM, "held_out_nll", lambda *a: 1.0)
    assert HM.gibbs_grid(empty, empty, ((8.0, 4.0, 2.0), (8.0, 8.0, 2.0)), 3, 3, 2, 4, 2, 1)[0] == 0


def test_draws_of_a_piece_follow_its_key_alone():
    ys, keys = [np.arange(n) % 3 for n in (4, 7, 2)], np.array([11, -5, 12])
    numbers = [HM.drawn_numbers(keys[[i]], HM.Packed([y]), 3) for i, y in enumerate(ys)]
    pack = HM.Packed(ys)
    assert all(np.array_equal(a, b) for a, b in zip(pack.split(HM.drawn_numbers(keys[pack.order], pack, 3)), numbers))
    many = HM.drawn_numbers(np.arange(500), HM.Packed([np.zeros(200)] * 500), 4)
    assert np.abs(np.bincount((many * 10).astype(int), minlength=10) / 1e5 - 0.1).max() < 0.005 and len(np.unique(many)) == 100_000
    z, p = np.array([0, 1, 1, 0, 0, 1]), HM.example_parameters(2, 3)
    first, moves, emitted = HM.path_counts(p, HM.Packed([np.array([0, 2, 1]), np.array([1, 2]), np.array([0])]), z)
    # rows are step by step: states 0 0 1, 1 0 and 1 of symbols 0 2 1, 1 2 and 0
    assert first.tolist() == [1, 2] and moves.tolist() == [[1, 1], [1, 0]] and emitted.tolist() == [[1, 0, 2], [1, 2, 0]]


def even_draws(p, pack, uniform, rng):
    even, odd = HM.halves(pack)
    z, follows = HM.drawn_evens(p, even, odd, uniform)
    return z, HM.filled(p, HM.even_counts(p, even, z, follows), rng)


def test_counts_from_even_steps_follow_the_posterior():
    p, rng, n = HM.Parameters.start(2, 3, 3), np.random.default_rng(0), 4000
    for y in (np.array([1]), np.array([2, 0]), np.array([0, 2, 1]), np.array([0, 2, 1, 1])):
        want, drawn = Counter(), Counter()
        paths, pack = all_paths(p, y), HM.Packed([y])
        for path, joint in paths.items():
            want[tuple(np.concatenate([x.ravel() for x in HM.path_counts(p, pack, np.array(path))]).tolist())] += joint / sum(paths.values())
        for _ in range(n):
            z, counts = even_draws(p, pack, rng.random(len(y[::2])), rng)  # one number for two tokens
            drawn[tuple(np.concatenate([x.ravel() for x in counts]).tolist())] += 1
        assert set(drawn) <= set(want) and all(abs(drawn[k] / n - v) < 0.035 for k, v in want.items())


def test_counts_of_many_sequences_from_even_steps():
    p, rng = HM.Parameters.start(3, 4, 5), np.random.default_rng(1)
    ys = [rng.integers(0, 4, n) for n in (5, 2, 0, 1, 6, 6, 3)]
    pack = HM.Packed([y for y in ys for _ in range(1500)])
    _, got = even_draws(p, pack, rng.random(len(HM.halves(pack)[0].y)), rng)
    want = HM.expectations(p, HM.Packed(ys))
    assert got[0].sum() == 6 * 1500 and got[1].sum() == 17 * 1500 and got[2].sum(0).tolist() == [1500 * sum((y == v).sum() for y in ys) for v in range(4)]
    assert all(np.abs(a / 1500 - b).max() < 0.12 for a, b in zip(got, want))


def test_unlikely_symbols_do_not_end_a_draw():
    likely = HM.Parameters(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.3, 0.7], [0.6, 0.4]]))
    unlikely = HM.Parameters(likely.initial, likely.transition, likely.emission * np.array([1e-120, 1e-150]))
    pack = HM.Packed([np.arange(n) % 2 for n in range(1, 60)])
    uniform = np.random.default_rng(2).random(len(HM.halves(pack)[0].y))
    z, _ = even_draws(likely, pack, uniform, np.random.default_rng(3))
    assert np.array_equal(z, even_draws(unlikely, pack, uniform, np.random.default_rng(3))[0]) and 0 < z.mean() < 1


def test_drawn_counts_do_not_depend_on_packs(spark, monkeypatch):
    rng, p = np.random.default_rng(4), HM.Parameters.start(4, 5, 6)
    df = spark.createDataFrame([(f"p{i}", rng.integers(0, 5, n).tolist()) for i, n in enumerate((3, 9, 1, 0, 9, 40, 2))], "piece_id string, tokens array<int>")
    one, other = (HM.drawn_counts(HM.laid(df, most), p, 7, np.random.default_rng(8)) for most in (10, 1000))
    assert all(np.array_equal(a, b) for a, b in zip(one, other)) and [int(x.sum()) for x in one] == [6, 58, 64]
    assert HM.drawn_counts(df.limit(0), p, 7, rng) is None
    monkeypatch.setattr(HM, "FEW", 0)  # as with many symbols: all states are drawn where the sequences are
    assert [int(x.sum()) for x in HM.drawn_counts(df, p, 7, rng)] == [6, 58, 64]


def test_tables_of_many_customers_are_few_draws():
    n, a, rng = np.array([[0, 1], [5_000_000, 300]]), np.array([[3.0, 3.0], [6.0, 0.0]]), np.random.default_rng(9)
    draws = np.array([HM.table_count(n, a, rng) for _ in range(3000)])
    q = 6.0 / (6.0 + np.arange(5_000_000))
    assert (draws[:, 0] == [0, 1]).all() and abs(draws[:, 1, 0].mean() - q.sum()) < 0.7 and abs(draws[:, 1, 0].var() / (q * (1 - q)).sum() - 1) < 0.1


def test_gibbs_grid(spark):
    assert (M.HDP_STATES, M.HDP_SWEEPS, M.HDP_BURN_IN, len(M.HDP_GRID)) == (24, 120, 60, 3)
    df = spark.createDataFrame([(f"p{i}", [0, 1, 0, 1]) for i in range(4)], "piece_id string, tokens array<int>")
    train, held = HM.begun(df, 2), HM.begun_slices(df, 2, 3)
    best, p, chains = HM.gibbs_grid(train, held, ((8.0, 4.0, 2.0), (8.0, 8.0, 2.0)), 3, 3, 2, 4, 2, 1)
    nlls = [nll for nll, _ in chains]
    assert nlls[best] == min(nlls) and all(len(t) == 4 for _, t in chains) and math.isclose(HM.held_out_nll(held, p, 2), min(nlls), rel_tol=1e-9)


def test_registered_orders_reach_eight(spark, tmp_path):
    rng = np.random.default_rng(7)
    known = [int(x) for x in rng.integers(0, 2, 64)]  # binary, so that only long contexts tell what follows
    rows = [(f"p{i}", known, None) for i in range(500)]
    spark.createDataFrame(rows, "piece_id string, tokens array<int>, prepared_at timestamp").write.parquet(str(tmp_path / "prepared_pieces.parquet"))
    splits = [(f"p{i}", "validation" if i > 490 else "train", None) for i in range(500)]
    spark.createDataFrame(splits, "piece_id string, split string, registered_at timestamp").write.parquet(str(tmp_path / "score_records.parquet"))
    got = {r["depth"]: r["nll"] for r in M.vom04(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 4, 8] and min(got, key=got.get) == 8


def test_harmony(spark):
    sets = spark.createDataFrame([("a", [0, 4, 7, 11, 2]), ("b", [2, 4, 5, 7, 9, 11, 0]), ("c", [])], "k string, pcs array<int>")
    marked = H.with_bits(sets, "pcs")
    chord = {r["bits"]: r["label"] for r in H.chord_candidates(marked, 1).collect()}
    bits = {r["k"]: r["bits"] for r in marked.collect()}
    assert chord[bits["a"]] == "C:maj9"
    modes = [r["label"] for r in H.mode_candidates(marked.where("k = 'b'"), 7).collect()]
    assert "D:dorian" in modes and H.chord_states(spark).count() == 252 and H.modal_contexts(spark).count() == 84
    assert all(math.isclose(sum(H.emission(r, iv)), 1) for r in range(12) for _, _, iv in H.CHORDS)
    rows = H.transition_scores(spark).groupBy("i").agg(F.sum("p").alias("s")).collect()
    assert len(rows) == 252 and all(math.isclose(r["s"], 1) for r in rows)
