"""Sequence operators: literal expectations."""

from pyspark.sql import functions as F

from scorelake.operators import sequences as S


def column(df, order, name):
    return [r[name] for r in df.orderBy(order).collect()]


def test_windows_and_slices(spark):
    n = spark.createDataFrame([("a", 150), ("b", 129), ("c", 0), ("d", 20)], "k string, n int")
    train = {tuple(r) for r in S.train_windows(n).select("k", "start", "stop").collect()}
    assert train == {("a", 0, 128), ("a", 64, 150), ("b", 0, 128), ("b", 64, 129)}
    evaluation = {tuple(r) for r in S.eval_slices(n).select("k", "start", "stop").collect()}
    assert evaluation == {("a", 0, 128), ("a", 128, 150), ("b", 0, 128), ("b", 128, 129), ("d", 0, 20)}


def test_exposure(spark):
    n = spark.createDataFrame([("a", 320)], "k string, n int")
    assert max(r["times"] for r in S.exposure(n, "k").collect()) > 1
    assert {r["times"]: r["n_events"] for r in S.exposure(n, "k", stride=128).collect()} == {1: 320}


def test_intervals_and_segments(spark):
    rows = spark.createDataFrame([("a", 0, 60), ("a", 1, 62), ("a", 2, 80), ("b", 0, 50), ("b", 1, None)], "k string, t int, m int")
    assert column(S.intervals(rows, "k", "t", "m").where("k = 'a'"), "t", "token") == [0, 15, 25]
    states = spark.createDataFrame([("a", i, s) for i, s in enumerate([1, 1, None, None, 2, 1])] + [("b", 0, 1)], "k string, t int, s int")
    got = {tuple(r) for r in S.segments(states, "k", "t", "s").collect()}
    assert got == {("a", 1, 0, 2), ("a", None, 2, 4), ("a", 2, 4, 5), ("a", 1, 5, 6), ("b", 1, 0, 1)}


def test_transitions_never_cross_sequences(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 0, 2), ("b", 1, 0)], "k string, t int, s int")
    grid = {(r["i"], r["j"]): r["n"] for r in S.transitions(rows, "k", "t", "s", 3).collect()}
    assert [[grid[i, j] for j in range(3)] for i in range(3)] == [[0, 1, 0], [0, 0, 0], [1, 0, 0]]


def test_ngrams_start_with_bos(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 2, 0)], "piece_id string, t int, token int")
    got = {(r["k"], r["context"], r["token"]): r["n"] for r in S.ngram_counts(rows, "piece_id", "t", "token", 2, 9).collect()}
    assert got == {(0, "", 0): 2, (0, "", 1): 1, (1, "9", 0): 1, (1, "0", 1): 1, (1, "1", 0): 1, (2, "9,0", 1): 1, (2, "0,1", 0): 1}


def test_slice_contexts(spark):
    rows = spark.createDataFrame([("a", t, t) for t in range(5)], "k string, t int, x int")
    got = S.slice_context(rows, "k", "t", "x", 3, 3, 5)
    assert column(got, "t", "context") == [[5], [5, 0], [5, 0, 1], [5], [5, 3]]


def test_bins_and_classes(spark):
    rows = spark.createDataFrame([(0.375, 1.0), (0.3, 2.0), (9.0, 1.5), (0.75, 1.25), (1.5, None)], "d double, b double")
    got = rows.select(S.nearest_bin(F.col("d"), [0.25, 0.5, 1.0, 2.0, 4.0]).alias("bin"), S.metrical_class(F.col("b")).alias("level")).collect()
    assert [tuple(r) for r in got] == [(0, "downbeat"), (0, "beat"), (4, "offbeat"), (1, "subbeat"), (2, "unknown")]


def test_fingerprints_ignore_transposition(spark):
    rows = spark.createDataFrame([("a", [1, 3, 2]), ("b", [4, 6, 5]), ("c", [1, 3, 3]), ("d", [1])], "k string, x array<int>")
    fp = {r["k"]: r["f"] for r in rows.select("k", S.fingerprint(F.col("x")).alias("f")).collect()}
    assert fp["a"] == fp["b"] != fp["c"] and fp["d"] is None and len(fp["a"]) == 16


def test_running_values(spark):
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate([3.0, 2.0, 2.0, 4.0, 1.0])], "k string, t int, x double")
    got = S.best_so_far(rows, "k", "t", "x")
    assert column(got, "t", "patience") == [0, 0, 1, 2, 0] and column(got, "t", "improved") == [True, True, False, False, True]
    sticks = S.stick_breaking(spark.createDataFrame([("a", i, 0.5) for i in range(3)], "k string, t int, v double"), "k", "t", "v")
    assert [round(x, 9) for x in column(sticks, "t", "weight")] == [0.5, 0.25, 0.125]


def test_padding_and_shift(spark):
    rows = spark.createDataFrame([("a", [1, 2, 3]), ("b", [])], "k string, x array<int>")
    assert {r["k"]: (r["padded"], r["n_real"]) for r in S.padded(rows, "k", "x", 2, 9).collect()} == {"a": ([1, 2], 2), "b": ([9, 9], 0)}
    long = spark.createDataFrame([("a", 0, 4), ("a", 1, 5)], "k string, t int, x int")
    assert column(S.bos_shift(long, "k", "t", "x", 60), "t", "input") == [60, 4]


def test_emissions_broadcast_no_tokens(spark, tmp_path):
    from scorelake.plans import sequences as Q

    fields = "offset double, duration double, kind string, label string, pitch_classes array<int>, midi_pitches array<int>, representative_midi int, measure int, beat double, extracted_at timestamp"
    rows = [("a", t, pc) for t, pc in ((0, 3), (1, 3), (2, None), (3, 5), (-1, 5))] + [("b", 0, 5), ("c", 0, 5)]
    played = spark.createDataFrame(rows, "piece_id string, index int, representative_pitch_class int")
    played.select("*", *[F.lit(None).cast(k).alias(n) for n, k in (f.split(" ") for f in fields.split(", "))]).write.parquet(str(tmp_path / "musical_events.parquet"))
    held = spark.createDataFrame([("a", [7, 7, None], None), ("b", [7, 8], None), ("d", [7], None)], "piece_id string, tokens array<int>, prepared_at timestamp")
    held.write.parquet(str(tmp_path / "prepared_pieces.parquet"))
    out = Q.agg09(spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {(3, 7, 2), (None, None, 1), (5, 7, 1)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    none = spark.createDataFrame([], "k string, t int, s int")
    assert S.segments(none, "k", "t", "s").collect() == [] and S.ngram_counts(none, "k", "t", "s", 2, 9).collect() == []
