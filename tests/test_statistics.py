"""Statistics, structural agreement, fronts, samples and audits."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import quality as Q
from scorelake.operators import sampling as R
from scorelake.operators import statistics as T
from scorelake.operators.components import connected_components


def test_repeats_are_averaged_before_pairing(spark):
    rows = spark.createDataFrame(
        [("a", "w1", 1.0), ("a", "w1", 3.0), ("b", "w1", 6.0), ("a", "w2", 12.0), ("b", "w2", 3.0), ("a", None, 9.0), ("b", "w3", None)],
        "model string, work string, nll double",
    )
    d = T.paired(T.work_means(rows, "model", "work"))
    assert sorted(r["difference"] for r in d.collect()) == [-4.0, 9.0]
    one = T.paired_summary(d).first()
    assert (one["n_pairs"], one["mean"], one["median"]) == (2, 2.5, 2.5)


def test_holm(spark):
    rows = spark.createDataFrame([("a", "b", 0.8), ("a", "c", 0.01), ("b", "c", 0.6), ("c", "d", None)], "a string, b string, p double")
    got = {(r["a"], r["b"]): r["holm"] for r in T.holm(rows, "p", "a", "b").collect()}
    assert got["a", "b"] == 1.0 and math.isclose(got["a", "c"], 0.03) and got["b", "c"] == 1.0 and got["c", "d"] is None


def test_wilcoxon(spark):
    values = [1.0, -2.0, 3.0, 3.0, 0.0, -4.0, 5.0]
    rows = spark.createDataFrame([("a", "b", f"w{i}", v) for i, v in enumerate(values)], "model_a string, model_b string, work string, difference double")
    one = T.wilcoxon(rows).first()
    assert (one["n_nonzero"], one["w_plus"], one["w_minus"], one["statistic"]) == (6, 14.0, 7.0, 7.0)
    assert 0.4 < one["p_value"] < 0.6
    assert T.wilcoxon_p(1.0, 1, 0.0) is None
    # all 2^5 signs enumerated: sums of 1 or less are 2 of 32 on either side
    assert T.wilcoxon_p(1.0, 5, 0.0) == 4 / 32 and T.wilcoxon_p(0.0, 6, 0.0) == 2 / 64
    exact = spark.createDataFrame([("a", "b", f"w{i}", v) for i, v in enumerate([1.0, -2.0, 3.0, 4.0, 5.0])], rows.schema)
    assert T.wilcoxon(exact).first()["p_value"] == 6 / 32


def test_bootstrap_takes_ten_thousand_resamples(spark):
    values = [0.3, -1.0, 2.5, 0.7]
    df = spark.createDataFrame([("a", "b", f"w{i}", x) for i, x in enumerate(values)], "model_a string, model_b string, work string, difference double")
    pick = lambda b, i: values[int(hashlib.md5(f"7:{b}:{i}".encode()).hexdigest()[:8], 16) % 4]
    means = np.array([sum(pick(b, i) for i in range(4)) / 4 for b in range(10_000)])
    few = T.bootstrap(df, 200).first()
    got = T.bootstrap(df).first()
    assert np.allclose([got["low"], got["high"]], np.percentile(means, [2.5, 97.5]), atol=1e-6)
    assert np.allclose([few["low"], few["high"]], np.percentile(means[:200], [2.5, 97.5]), atol=1e-6) and few != got


def test_bootstrap_moves_no_draws(spark):
    values = {"b": [0.3, -1.0, 2.5, 0.7, 4.0, 1.5], "c": [5.0, 1.0, -2.0]}
    df = spark.createDataFrame([("a", m, f"w{i}", x) for m, v in values.items() for i, x in enumerate(v)], "model_a string, model_b string, work string, difference double")
    out = T.bootstrap(df, 50)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # groups of resamples, not draws
    pick = lambda v, b, i: v[int(hashlib.md5(f"7:{b}:{i}".encode()).hexdigest()[:8], 16) % len(v)]
    for r in out.collect():
        v = values[r["model_b"]]
        means = [sum(pick(v, b, i) for i in range(len(v))) / len(v) for b in range(50)]
        assert np.allclose([r["low"], r["high"]], np.percentile(means, [2.5, 97.5]), atol=1e-6)


def test_agreement(spark):
    def score(a, b):
        r = T.agreement(spark.createDataFrame(list(zip(a, b)), "x string, y string"), "x", "y").first()
        return r["nmi"], r["ari"]

    assert score("aabb", "xyxy") == (0.0, -0.5) and score("aabb", "ppqq") == (1.0, 1.0) and score("aa", "xx") == (1.0, 1.0)


def test_boundaries(spark):
    cases = {"one": ([2, 6, 10], [2, 6, 11]), "two": ([10, 11], [10]), "none": ([], []), "half": ([1], [])}
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in cases.items()], "k string, a array<int>, b array<int>")
    f0 = {r["k"]: r["f1"] for r in T.boundary_scores(rows, "k", "a", "b").collect()}
    f1 = {r["k"]: r["f1"] for r in T.boundary_scores(rows, "k", "a", "b", 1).collect()}
    assert f0 == {"one": 0.666667, "two": 0.666667, "none": 1.0, "half": 0.0} and f1["one"] == 1.0 and f1["two"] == 0.666667
    sided = spark.createDataFrame([("no prediction", [1], []), ("no reference", [], [1])], "k string, a array<int>, b array<int>")
    rows = {r["k"]: (r["precision"], r["recall"], r["f1"]) for r in T.boundary_scores(sided, "k", "a", "b").collect()}
    assert rows == {"no prediction": (1.0, 0.0, 0.0), "no reference": (0.0, 1.0, 0.0)}


def test_fronts(spark):
    rows = [("balanced", 2.0, 2.0, 0.8), ("dominated", 3.0, 3.0, 0.7), ("predictive", 1.0, 5.0, 0.8), ("duplicate", 2.0, 2.0, 0.8), ("unknown", None, 9.0, 0.1), ("nan", float("nan"), 9.0, 0.1)]
    df = spark.createDataFrame(rows, "m string, nll double, cost double, f double")
    assert {r["m"] for r in T.pareto_front(df, ["nll", "cost"], ["f"]).collect()} == {"balanced", "predictive", "duplicate", "unknown", "nan"}
    points = spark.createDataFrame([(i, (i * 37) % 101 / 10.0, (i * 53) % 97 / 10.0) for i in range(300)], "k int, x double, y double")
    want = {r["k"] for r in T.pareto_front(points, ["x", "y"]).collect()}
    assert {r["k"] for r in T.two_axis_front(points, "k", "x", "y").collect()} == want


def test_chains(spark):
    steady = [("1", i, -100.0 + 0.5 * (i % 2)) for i in range(60)] + [("2", i, -100.2 + 0.5 * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(steady, "c string, t int, v double")
    assert T.chain_verdict(T.drift(df, "c", "t", "v")).first()["verdict"] == "stable_within_the_observed_window"
    moving = spark.createDataFrame([("1", i, -1000.0 + 10 * i) for i in range(60)], "c string, t int, v double")
    assert T.chain_verdict(T.drift(moving, "c", "t", "v")).first()["verdict"] == "drift_detected"
    apart = spark.createDataFrame([(c, i, v) for c, v in (("1", -100.0), ("2", -200.0)) for i in range(60)], "c string, t int, v double")
    assert T.chain_verdict(T.drift(apart, "c", "t", "v")).first()["verdict"] == "chains_disagree"
    assert T.chain_verdict(T.drift(apart.limit(0), "c", "t", "v")).first()["verdict"] == "no_evidence"
    assert T.lag_one(apart, "c", "t", "v").first()["lag_one"] is None
    near = spark.createDataFrame([(60, -100.0, True, 4.0), (60, -101.0, True, 5.5)], "n int, late double, stable boolean, late_active double")
    assert T.chain_verdict(near.drop("late_active")).first()["verdict"] == "stable_within_the_observed_window"
    assert T.chain_verdict(near).first()["verdict"] == "chains_disagree"


def test_samples_and_splits(spark):
    rows = spark.createDataFrame([("s", f"p{i:02d}") for i in range(20)], "s string, k string")
    parts = R.nested_fractions(rows, "s", "k", [0.1, 0.5, 1.0], 1).collect()
    sets = {f: {r["k"] for r in parts if r["frac"] == f} for f in (0.1, 0.5, 1.0)}
    assert [len(sets[f]) for f in (0.1, 0.5, 1.0)] == [2, 10, 20] and sets[0.1] < sets[0.5] < sets[1.0]
    split = R.stratified_split(rows, ["s"], "k", 0.15, 0.1, 3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 3, "validation": 2, "train": 15}
    few = R.stratified_split(rows.limit(4), ["s"], "k", 0.1, 0.1, 3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in few} == {"test": 1, "validation": 1, "train": 2}
    n = spark.createDataFrame([(10,), (11,), (4,), (2,)], "n int")
    counts = R.ratio_counts(F.col("n"), {"a": 0.7, "b": 0.2, "c": 0.1})
    assert [tuple(r) for r in n.select(*[c.alias(k) for k, c in counts.items()]).collect()] == [(7, 2, 1), (8, 2, 1), (2, 1, 1), (2, 0, 0)]
    assert R.seeded_sample(rows, "k", 5, 1).count() == 5


def test_order_statistics(spark):
    rows = spark.createDataFrame([(x,) for x in (5, 1, 1, 9, 3)], "v int")
    assert tuple(R.order_statistics(rows, "v", {"a": lambda n: F.lit(0), "b": lambda n: F.floor(n / 2), "c": lambda n: n - 1}).first()) == (1, 3, 9)


def test_audits(spark):
    labels = spark.createDataFrame([("Canon_in_D_easy_piano.mxl",), ("Chopin Nocturne_Op.9 No.2",), ("Beethoven Sonata No.1",)], "x string")
    got = [tuple(r) for r in labels.select(Q.canonical_work(F.col("x")), Q.suffix(F.col("x"))).collect()]
    assert got == [("canon in d", ".mxl"), ("chopin nocturne op 9 no", ".2"), ("beethoven sonata no", ".1")]
    scored = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 7), ("b", 0)], "k string, i int")
    out = {r["k"]: (r["duplicate"], r["out_of_range"], r["omitted"], r["ok"]) for r in Q.coverage(spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "k string, n int"), scored, "k", "n", "i").collect()}
    assert out == {"a": (1, 1, 1, False), "b": (0, 0, 0, True), "c": (0, 0, 2, False)}
    leak = Q.leakage(spark.createDataFrame([("w", "train"), ("w", "test"), ("v", "test"), (None, "train")], "w string, s string"), "w", "s").collect()
    assert [(r["w"], r["splits"]) for r in leak] == [("w", "test,train")]


def test_components(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("x", "y"), ("y", "z"), ("hub", "hub"), (None, "q")] + [("star", f"s{i}") for i in range(30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert {got[f"n{i}"] for i in range(41)} == {"n0"} and got["z"] == "x" and got["hub"] == "hub" and "q" not in got
    assert len({got[f"s{i}"] for i in range(30)} | {got["star"]}) == 1
    assert connected_components(spark.createDataFrame([], "src string, dst string")).collect() == []


@pytest.mark.parametrize("a, b, tol, n", [([1, 5], [2, 6], 1, 2), ([1, 2], [2], 1, 1), ([], [1], 3, 0)])
def test_matching(a, b, tol, n):
    assert T.match_boundaries(a, b, tol) == n
