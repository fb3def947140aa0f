"""Costs, resources, audits, scalars, sampling and live sequences against literal values."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions import scalars as N
from scorelake.operators import audits as A
from scorelake.operators import harmony as H
from scorelake.operators import hidden_markov as HM
from scorelake.operators import quality as Q
from scorelake.operators import sequences as S
from scorelake.plans import report as P
from scorelake.plans import runs as R
from scorelake.streaming import sequences as ST


def test_costs_by_what_was_measured(spark):
    rows = [("a", 3.0, 2.0, 1.0, 0.5, 9.0), ("b", 3.0, None, None, None, 9.0), ("c", None, 2.0, 1.0, 0.5, 9.0), ("d", None, None, None, None, 9.0), ("e", None, None, None, 0.5, None)]
    df = spark.createDataFrame(rows, "k string, selection double, selected_fit double, selected_validation double, evaluation double, legacy double")
    got = {r["k"]: (r["total"], r["cost_status"]) for r in Q.protocol_costs(df).collect()}
    assert got == {
        "a": (3.5, "separated"), "b": (3.0, "partially_separated"), "c": (3.5, "partially_separated"), "d": (9.0, "unseparated_legacy_total"), "e": (0.5, "unmeasured"),
    }


def test_scalars(spark):
    row = spark.range(1).select(
        N.dirichlet_log_density(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)), [2.0, 3.0, 4.0]).alias("d"),
        F.array(*[N.relative_bucket(F.lit(x)) for x in (-3, 0, 15, 16, 40, 127, 128, 9999)]).alias("b"),
        F.array(*[N.short_number(F.lit(x)) for x in (0.25, 1.0, 1 / 3, 12.5, 0.0625, 100.0, 0.001953125)]).alias("n"), N.interval_label(F.lit(-3)).alias("i"),
    ).first()
    assert math.isclose(row["d"], math.lgamma(9) - math.lgamma(2) - math.lgamma(3) - math.lgamma(4) + math.log(0.2) + 2 * math.log(0.3) + 3 * math.log(0.5))
    assert row["b"] == [0, 0, 15, 16, 23, 31, 31, 31] and row["i"] == "INT_-3"
    assert row["n"] == [f"{x:g}" for x in (0.25, 1.0, 1 / 3, 12.5, 0.0625, 100.0, 0.001953125)]
    assert N.vocabulary_size("pitch_class_duration", 5, 4) == 60 and N.vocabulary_size("event_pitch_duration_metrical", 5, 4) == 260
    with pytest.raises(ValueError):
        N.vocabulary_size("words", 1, 1)


def test_gumbel_draws_follow_the_weights(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    weights = spark.createDataFrame([(0, 60), (1, 30), (2, 10), (3, 1)], "v int, w bigint")
    drawn = Counter(r["v"] for r in S.gumbel_draws(keys, "k", weights, "v", "w", 3, 3, 1.0).collect())
    assert 3 not in drawn and all(abs(drawn[v] / 4000 - w / 100) < 0.03 for v, w in ((0, 60), (1, 30), (2, 10)))
    cold = Counter(r["v"] for r in S.gumbel_draws(keys, "k", weights, "v", "w", 3, 3, 0.05).collect())
    assert cold[0] == 4000


def test_length_batches_hold_their_cells(spark):
    df = spark.createDataFrame([(f"p{i}", 1 + i % 70) for i in range(500)] + [("none", 0)], "k string, n int")
    rows = S.length_batches(df, "k", "n", 256).groupBy("class", "range", "batch").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("m"), F.min("n").alias("least")).collect()
    assert sum(r["c"] for r in rows) == 500 and all(r["c"] * r["m"] <= 256 and r["m"] <= 2 ** r["class"] for r in rows)


def artifact_frame(spark, change=()):
    raw = "model,frac,data_seed,test_nll\nm,1.0,1,2.0\nm,1.0,2,4.0\n"
    files = {
        "config.json": '{"data_seeds": [1, 2], "train_fractions": [1.0]}', "checkpoint.jsonl": '{"cell": "1/1.0"}\n{"cell": "2/1.0"}\n{"cel', "results_raw.csv": raw,
        "results_summary.csv": "model,frac,mean_test_nll,runs\nm,1.0,3.0,2\n", "protocol_audit.json": '{"status": "passed"}',
    }
    files |= dict(change)
    return spark.createDataFrame([(k, v) for k, v in files.items() if v is not None], "name string, text string"), list(files)


@pytest.mark.parametrize(
    "change, check, status",
    [
        ({}, "overall", "passed"), ({"results_raw.csv": None}, "artifacts_present", "incomplete"), ({"config.json": "{"}, "json_parsable", "failed"),
        ({"checkpoint.jsonl": '{"cell": "1/1.0"}'}, "cells_completed", "incomplete"), ({"protocol_audit.json": '{"status": "failed"}'}, "cells_completed", "incomplete"),
        ({"results_summary.csv": "model,frac,mean_test_nll,runs\nm,1.0,3.5,2\n"}, "summary_matches_raw", "failed"),
        ({"config.json": '{"data_seeds": [1, 2, 3], "train_fractions": [1.0]}'}, "config_matches_rows", "incomplete"),
        ({"config.json": '{"data_seeds": [1], "train_fractions": [1.0]}'}, "config_matches_rows", "failed"), ({"run_summary.json": "{"}, "run_summary_present", "failed"),
    ],
)
def test_run_audit(spark, change, check, status):
    files, _ = artifact_frame(spark, change)
    rows = {r["check_name"]: r["status"] for r in A.audit_run(files, list(artifact_frame(spark)[1]), ["config.json", "protocol_audit.json"]).collect()}
    assert len(rows) == 7 and rows[check] == status
    assert (rows["overall"] == "passed") == (not change or check == "run_summary_present")


def test_requirement_kinds(spark):
    files = spark.createDataFrame([("tests.json", json.dumps({"status": "passed", "tests_run": 1, "test_ids": ["test_a"]}))], "name string, text string")
    each = spark.createDataFrame([("r1", "m.json", '{"s": "ok"}'), ("r2", "m.json", '{"s": "bad"}'), ("r3", "other", "")], "run string, name string, text string")
    context = {"files": files, "runs": each, "package": spark.createDataFrame([("p", "changed")], "path string, status string"), "costs": None, "scenarios": spark.createDataFrame([(1.0,), (None,)], "cost double")}
    ask = lambda **rule: A.requirement({"name": "x", **rule}, context).first()["status"]
    assert ask(type="context_file_exists", file="tests.json") == "passed" and ask(type="context_file_exists", file="no", missing_status="incomplete") == "incomplete"
    assert ask(type="package_verified") == "failed" and ask(type="files_in_each_run", file="m.json") == "partial"
    assert ask(type="json_field_in_each_run", file="m.json", field="s", allowed=["ok"]) == "failed"
    assert ask(type="test_report_passed", file="tests.json", fragments=["a"]) == "passed" and ask(type="test_report_passed", file="tests.json", fragments=["b"]) == "partial"
    assert ask(type="resource_costs_complete", models=[], fields=["x"]) == "partial" and ask(type="cost_scenarios_computed") == "partial"
    with pytest.raises(ValueError):
        ask(type="unheard")


def test_chord_model_decodes_its_own_chords(spark):
    p = R.chord_parameters(spark)
    assert np.allclose(p.transition.sum(1), 1) and np.allclose(p.emission.sum(1), 1)
    y = np.array([0, 4, 7, 0, 4, 7, 0, 4, 7])
    pack = HM.Packed([y])
    path = pack.split(HM.best_paths(p, pack))[0]
    assert len(set(path.tolist())) == 1 and p.emission[path[0], [0, 4, 7]].min() > 0.1


def test_relations_change_no_path(spark):
    p, rng = R.chord_parameters(spark), np.random.default_rng(8)
    relations = HM.Relations(HM.log_floor(p.transition), H.move_relations())
    pack = HM.Packed([np.repeat(rng.integers(0, 12, n), 1 + k % 3) for k, n in enumerate((0, 1, 2, 7, 7, 30, 41, 12))])
    assert HM.best_paths(p, pack, relations).tolist() == HM.best_paths(p, pack).tolist()
    score = rng.normal(size=(252, 300)).round(1)  # many are equal
    dense = (score.T[:, None, :] + HM.log_floor(p.transition).T[None]).max(2).T
    assert np.array_equal(relations.best(score, 77), dense)
    with pytest.raises(ValueError):
        HM.Relations(HM.log_floor(p.transition), H.move_relations()[1:])


def test_posterior_mean_lists_every_emission(spark, monkeypatch):
    p = HM.example_parameters(2, 3)
    monkeypatch.setattr(P, "hdp_grid", lambda spark, d: (0, p, []))
    rows = P.agg31(spark, "").collect()
    assert {(r["state"], r["pc"]): r["p"] for r in rows} == {(i, j): p.emission[i, j] for i in range(2) for j in range(3)}


def test_live_sequences_keep_state_between_batches(spark, tmp_path):
    for i, values in enumerate(([("u", 1, "a"), ("u", 2, "a")], [("u", 3, "b"), ("v", 1, "a")], [("u", 4, "b"), ("u", 5, "a")])):
        spark.createDataFrame(values, "k string, t int, e string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("k string, t int, e string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    grams = ST.run_all(ST.live_ngrams(source(), "k", ["t"], "e", 2), str(tmp_path / "g"), str(tmp_path / "gc"))
    assert sorted("".join(r["gram"]) for r in grams.collect()) == ["aa", "ab", "ba", "bb"]
    runs = ST.run_all(ST.live_segments(source(), "k", ["t"], "e"), str(tmp_path / "s"), str(tmp_path / "sc"))
    assert sorted((r["e"], r["length"]) for r in runs.collect()) == [("a", 2), ("b", 2)]
