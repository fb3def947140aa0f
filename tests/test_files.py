"""Sources, sinks, streams and the driver's contract."""

import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorelake.functions import text as X
from scorelake.plans import catalogue
from scorelake.sources import catalogs, musicxml, sinks
from scorelake.streaming import sequences as ST

SCORE = """<score-partwise><part id="P1"><measure number="1"><attributes><divisions>2</divisions><time><beats>4</beats><beat-type>4</beat-type></time></attributes>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration></note>
<note><pitch><step>G</step><octave>3</octave></pitch><duration>4</duration></note><note><chord/><pitch><step>B</step><octave>3</octave></pitch><duration>4</duration></note>
<note><rest/><duration>1</duration></note><backup><duration>7</duration></backup><note><pitch><step>E</step><alter>-1</alter><octave>5</octave></pitch><duration>1</duration></note>
</measure><measure number="2"><note><grace/><pitch><step>D</step><octave>4</octave></pitch></note></measure></part></score-partwise>"""


def test_score_parsing():
    rows = musicxml.parse(SCORE.encode())
    assert [(r[1], r[2], r[3], r[5]) for r in rows] == [(0.0, 1.0, "note", [60]), (0.0, 0.5, "note", [75]), (1.0, 2.0, "chord", [55, 59])]
    assert rows[2][4] == "G3.B3" and rows[2][7] == 2.0
    assert [r[3] for r in musicxml.parse(SCORE.encode(), rests=True)].count("rest") == 1
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="s.xml"/></rootfiles></container>')
        z.writestr("s.xml", SCORE)
    assert musicxml.parse(zipped.getvalue()) == rows
    events = [(0.0, 1.5, [60]), (1.0, 0.3333, [62, 66]), (4.0, 1.0, [61])]
    assert [(r[1], r[2], r[5]) for r in musicxml.parse(musicxml.write(events).encode())] == events


def test_reading_a_folder(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "one.XML").write_text(SCORE)
    (tmp_path / "in" / "bad.mxl").write_bytes(b"PK nothing")
    (tmp_path / "in" / "notes.txt").write_text("no score")
    rows = {r["piece_id"]: (r["status"], r["reason"], r["n_events"]) for r in musicxml.read_scores(spark, str(tmp_path / "in"), least=2).collect()}
    assert rows["a/one.XML"] == ("prepared", None, 3) and rows["bad.mxl"][:2] == ("excluded", "parse_error") and len(rows) == 2
    assert catalogs.discover_scores(spark, str(tmp_path / "in")).count() == 2


class Kept:
    """Stands in for a frame: gives the function that would run on its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_few_scores_are_in_python_at_once():
    rows = [(float(i), 1.0, [60, 64]) for i in range(40)]
    events = [{"offset": a, "duration": b, "midi_pitches": c} for a, b, c in rows]
    batch = pa.RecordBatch.from_pylist([{"piece_id": f"p{i}", "events": events[: i % 41]} for i in range(300)])
    written = list(musicxml.write_files(Kept())(iter([batch])))
    parsed = list(musicxml.parse_files(Kept())(iter(written)))
    assert max(b.num_rows for b in written + parsed) <= musicxml.AT_ONCE and sum(b.num_rows for b in parsed) == 300
    got = [r for b in parsed for r in b.to_pylist()]
    assert [r["n_events"] for r in got] == [i % 41 for i in range(300)] and all(len(r["events"]) == (r["n_events"] if r["n_events"] >= 32 else 0) for r in got)
    assert [(e["offset"], e["duration"], e["midi_pitches"]) for e in got[40]["events"]] == rows
    brief = [r for b in musicxml.parse_files(Kept(), events=False)(iter(written)) for r in b.to_pylist()]
    assert [{k: v for k, v in r.items() if k != "events"} for r in got] == brief


def test_events_come_back_from_batches_of_scores(spark):
    rows = [(float(i), 1.0, [60 + i % 3, 72]) for i in range(33)]
    scores = spark.createDataFrame([(f"p{i}", musicxml.write(rows[: 31 + i % 3])) for i in range(150)], "piece_id string, content string").coalesce(1)
    parsed = musicxml.parse_files(scores)
    assert "MapInArrow" in parsed._jdf.queryExecution().executedPlan().toString()  # batches are cut before they become Python objects
    got = musicxml.exploded(parsed).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("midi_pitches")).alias("m"), F.max("offset").alias("last")).collect()
    assert {(r["piece_id"], r["n"], r["m"], r["last"]) for r in got} == {(f"p{i}", n, 2 * n, n - 1.0) for i in range(150) if (n := 31 + i % 3) >= 32}


def test_scores_are_rewritten_from_batches_of_events():
    frame = Kept()
    frame.sortWithinPartitions = frame.drop = frame.select
    lengths = [(f"p{i:03}", 31 + i % 5 + 2_000 * (i == 40)) for i in range(900)]
    rows = [{"piece_id": p, "offset": k / 2, "duration": 0.5, "midi_pitches": [60 + k % 7]} for p, n in lengths for k in range(n)]
    table = pa.Table.from_pylist(rows, pa.schema([("piece_id", pa.string()), ("offset", pa.float64()), ("duration", pa.float64()), ("midi_pitches", pa.list_(pa.int32()))]))
    out = list(musicxml.rewritten(frame)(iter(table.to_batches(max_chunksize=700))))  # pieces go on in the next batch
    got = [(r["piece_id"], r["index"], r["offset"], r["midi_pitches"]) for b in out for r in b.to_pylist()]
    assert got == [(p, k, k / 2, [60 + k % 7]) for p, n in lengths if n >= 32 for k in range(n)]
    assert len(out) > 2 and max(b.num_rows for b in out) < musicxml.ROWS_OUT + 2_100


def test_rewritten_scores_are_whole_or_fail(monkeypatch):
    frame = Kept()
    frame.sortWithinPartitions = frame.drop = frame.select
    rows = [{"piece_id": p, "offset": k / 2, "duration": 0.5, "midi_pitches": [60] * (k % 5 > 0)} for p in ("a", "b") for k in range(32)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("piece_id", pa.string()), ("offset", pa.float64()), ("duration", pa.float64()), ("midi_pitches", pa.list_(pa.int32()))]))
    got = [r for b in musicxml.rewritten(frame)(iter([batch])) for r in b.to_pylist()]
    assert [{k: r[k] for k in rows[0]} for r in got] == rows and {r["kind"] for r in got} == {"note", "rest"}
    monkeypatch.setattr(musicxml, "parse", lambda text, rests=False: [][1])
    with pytest.raises(ValueError, match="score a "):
        list(musicxml.rewritten(frame)(iter([batch])))


def test_rewritten_scores_are_read_in_one_python_stage(spark):
    from scorelake.plans import files as FI

    plan = FI.udtf01(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("Sort ") == 1 and "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1


def test_json_catalogs(spark, tmp_path):
    for i, body in enumerate([{"encodings": {"musicxml": "x"}}, {"encodings": [{"MusicXML": "y"}]}, {"encodings": []}, {}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(body))
    (tmp_path / "4.json").write_text("{torn")
    got = sorted((r["payload"] or "", r["status"]) for r in catalogs.nested_payloads(spark, str(tmp_path)).collect())
    assert got == [("", "missing_musicxml_encoding")] * 3 + [("x", "written"), ("y", "written")]
    names = spark.createDataFrame([("hicaz--sarki--duyek--bahar_olsa--fahri_kopuz",), ("hicaz",)], "n string")
    fields = catalogs.filename_fields(names, "n", ["makam", "form", "usul", "title", "composer"], {"composer": "unknown"}).collect()
    assert fields[0]["usul"] == "duyek" and fields[1]["form"] is None and fields[1]["composer"] == "unknown"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", float("inf")), ("d", None)], "k string, v double")
    values = [json.loads(r["value"])["v"] for r in sinks.strict_json(rows).collect()]
    assert values == [1.0, None, None, None]
    assert sinks.finite_payload({"a": [float("inf"), {"b": 1.5}]}) == {"a": [None, {"b": 1.5}]}
    cells = str(tmp_path / "cells")
    sinks.write_cells(rows.withColumn("cell", F.lit(1)), cells, "cell")
    sinks.write_cells(rows.limit(1).withColumn("cell", F.lit(2)), cells, "cell")
    sinks.write_cells(rows.limit(2).withColumn("cell", F.lit(1)), cells, "cell")
    assert {r["cell"]: r["count"] for r in spark.read.parquet(cells).groupBy("cell").count().collect()} == {1: 2, 2: 1}
    (tmp_path / "c.jsonl").write_text('{"k": "a", "n": 1}\n{"k": "b", "n"')
    assert [tuple(r) for r in sinks.read_checkpoint(spark, str(tmp_path / "c.jsonl"), "k string, n int").collect()] == [("a", 1)]


def test_evidence_package(tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    (run / "config.json").write_text('{"root": "/home/someone/data", "n": 1}')
    (run / "weights.bin").write_bytes(b"\x00\x01")
    out = tmp_path / "package"
    manifest = sinks.export_package({"first": str(run)}, str(out))
    assert len(manifest["files"]) == 2 and "/home" not in (out / "first/config.json").read_text() and sinks.verify_package(str(out)) == []
    assert sinks.seal(str(out), str(tmp_path / "1.zip")) == sinks.seal(str(out), str(tmp_path / "2.zip"))
    (out / "first/weights.bin").write_bytes(b"\x02")
    (out / "extra").write_text("x")
    assert sinks.verify_package(str(out)) == ["changed: first/weights.bin", "unexpected: extra"]
    with pytest.raises(FileExistsError):
        sinks.export_package({"first": str(run)}, str(out))
    with pytest.raises(ValueError):
        sinks.export_package({"..": str(run)}, str(tmp_path / "other"))
    assert not sinks.safe_relative("../x") and not sinks.safe_relative("/x") and sinks.safe_relative("a/b.json")


def test_text_functions(spark):
    rows = spark.createDataFrame(
        [("Chopin_Nocturne.mxl", None, "Easy Waltz", "/data/external/PDMX/a.mxl"), ("x.mxl", " Zoe ", "Sonata fingered", "/data/external/mine/a"), ("bwv_1.mxl", "", "Song", "/tmp/a")],
        "file string, given string, title string, path string",
    )
    c = F.col
    got = rows.select(X.composer(c("file"), c("given")), X.form(c("title")), X.arrangement(c("title")), X.source_label(c("path"))).collect()
    assert [tuple(r) for r in got] == [("Chopin", "waltz", "pedagogical_easy", "pdmx"), ("Zoe", "sonata", "annotated_fingering", "mine"), ("Bach", "piece", "standard", "unknown")]
    one = spark.range(1).select(
        X.difficulty(F.lit("x"), F.lit(1200), F.lit(8.4)).alias("d"), X.truth(F.lit(" YES ")).alias("t"), X.truth(F.lit("maybe")).alias("m"), X.number_list(F.lit("1, 2,,x")).alias("n"),
        X.redacted_paths(F.lit("at /home/me/x.csv see https://a.example/b/c")).alias("p"), X.safe_relative(F.lit("a/../b")).alias("s"),
    ).first()
    assert (one["d"], one["t"], one["m"], one["n"], one["s"]) == ("advanced", True, None, [1, 2, None], False) and one["p"] == "at <path> see https://a.example/b/c"


def test_number_lists_of_whole_pieces(spark, tmp_path):
    rows = [("a", list(range(40)), None), ("b", [5], None), ("c", [], None)]
    spark.createDataFrame(rows, "piece_id string, tokens array<int>, prepared_at timestamp").write.parquet(str(tmp_path / "prepared_pieces.parquet"))
    assert {tuple(r) for r in catalogue.stx18_whole(spark, str(tmp_path)).collect()} == {("a", 40, 780), ("b", 1, 5)}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1, 2.0), ("u", 3, 5.0), ("v", 1, 1.0)], "k string, t int, x double")
    source = str(tmp_path / "source")
    rows.coalesce(1).write.parquet(source)
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    first = ST.ingest_new(spark, source, target, state)
    assert first.count() == 3
    spark.createDataFrame([("u", 4, 4.0), ("u", 2, 9.0)], "k string, t int, x double").coalesce(1).write.mode("append").parquet(source)
    assert ST.ingest_new(spark, source, target, state).count() == 5
    live = ST.live_intervals(ST.file_stream(spark, source, per_trigger=1), "k", "t", "x")
    got = {(r["k"], r["t"]): r["interval"] for r in ST.run_all(live, str(tmp_path / "o2"), str(tmp_path / "s2")).collect()}
    assert got["u", 3] == 3.0 and got["v", 1] is None and len(got) == 5


def test_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns == ["piece_id", "n_tokens", "nll", "perplexity", "accuracy", "brier"]


def test_workers_get_the_package_path(spark):
    from pathlib import Path

    from scorelake.session import let_workers_import

    let_workers_import(spark)
    let_workers_import(spark)
    paths = spark.sparkContext.environment["PYTHONPATH"].split(":")
    assert paths.count(str(Path(__file__).resolve().parents[1])) == 1
