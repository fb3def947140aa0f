"""Scores in MusicXML, plain or zipped: read into events, or written from them.

The order of elements in a measure matters (``backup`` and ``forward`` move the clock), so
files are parsed as documents and not as a table of elements.
"""

from __future__ import annotations

import io
import itertools
import operator
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Semitone of each step, and the steps of the twelve pitch classes.
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SPELLED = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
NAMED = [f"{SPELLED[p % 12]}{p // 12 - 1}" for p in range(128)]
EVENT = "index int, offset double, duration double, kind string, label string, midi_pitches array<int>, measure int, beat double"
EVENT_FIELDS = [f.split(" ")[0] for f in EVENT.split(", ")]


def score_text(content: bytes) -> bytes:
    """The score document of a file: itself, or the root file of a zipped score."""
    if content[:2] != b"PK":
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if "META-INF/container.xml" in names:
            for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter():
                if e.tag.endswith("rootfile") and e.get("full-path") in names:
                    return z.read(e.get("full-path"))
        return z.read(next(n for n in names if n.endswith((".xml", ".musicxml")) and not n.startswith("META-INF")))


def _part_events(part: ElementTree.Element) -> list[dict]:
    out, clock, divisions, beats, beat_type = [], 0.0, 1.0, 4, 4
    for place, measure in enumerate(part.iter("measure")):
        start, last = clock, clock
        try:
            number = int(measure.get("number", place + 1))
        except ValueError:
            number = place + 1
        for e in measure:
            if e.tag == "attributes":
                divisions = float(e.findtext("divisions") or divisions)
                beats, beat_type = int(e.findtext("time/beats") or beats), int(e.findtext("time/beat-type") or beat_type)
            elif e.tag in ("backup", "forward"):
                step = float(e.findtext("duration") or 0) / divisions
                clock += -step if e.tag == "backup" else step
            elif e.tag == "note":
                child = {c.tag: c for c in e[::-1]}  # the first of each tag
                if "grace" in child:
                    continue
                length = float(child["duration"].text or 0) / divisions if "duration" in child else 0.0
                chord = "chord" in child
                at = last if chord else clock
                if not chord:
                    last, clock = clock, clock + length
                if "pitch" not in child:
                    out.append({"offset": at, "duration": length, "pitches": [], "measure": number, "beat": (at - start) * beat_type / 4 + 1})
                    continue
                pitch = {c.tag: c.text or "" for c in child["pitch"][::-1]}
                midi = STEPS[pitch["step"].upper()] + int(float(pitch.get("alter") or 0)) + 12 * (int(pitch["octave"]) + 1)
                if chord and out:
                    out[-1]["pitches"].append(midi)
                else:
                    out.append({"offset": at, "duration": length, "pitches": [midi], "measure": number, "beat": (at - start) * beat_type / 4 + 1})
    return out


def parse(content: bytes, rests: bool = False) -> list[tuple]:
    """Events of all parts in order of time, as tuples of EVENT; rests only if asked for."""
    root = ElementTree.fromstring(score_text(content))
    found = [e for part in root.iter("part") for e in _part_events(part)]
    found = [e for e in found if e["pitches"] or rests]
    found.sort(key=lambda e: e["offset"])
    rows = []
    for i, e in enumerate(found):
        pitches = sorted(e["pitches"])
        kind = "rest" if not pitches else "note" if len(pitches) == 1 else "chord"
        label = ".".join([NAMED[p] if 0 <= p < 128 else f"{SPELLED[p % 12]}{p // 12 - 1}" for p in pitches]) or "REST"
        rows.append((i, round(e["offset"], 6), round(e["duration"], 6), kind, label, pitches, e["measure"], round(e["beat"], 6)))
    return rows


def write(events: list[tuple[float, float, list[int]]], divisions: int = 10_000) -> str:
    """A one-part score of ``(offset, duration, midi pitches)`` in one measure."""
    body, clock = [], 0
    for offset, duration, pitches in events:
        at, length = round(offset * divisions), round(duration * divisions)
        if at != clock:
            body.append(f"<{'forward' if at > clock else 'backup'}><duration>{abs(at - clock)}</duration></{'forward' if at > clock else 'backup'}>")
        for k, p in enumerate(pitches):
            name = SPELLED[p % 12]
            alter = "<alter>1</alter>" if name.endswith("#") else ""
            body.append(
                f"<note>{'<chord/>' if k else ''}<pitch><step>{name[0]}</step>{alter}<octave>{p // 12 - 1}</octave></pitch><duration>{length}</duration></note>"
            )
        if not pitches:
            body.append(f"<note><rest/><duration>{length}</duration></note>")
        clock = at + length
    return (
        '<score-partwise version="3.1"><part-list><score-part id="P1"/></part-list><part id="P1"><measure number="1">'
        f"<attributes><divisions>{divisions}</divisions></attributes>{''.join(body)}</measure></part></score-partwise>"
    )


TAGGED = "piece_id string, status string, reason string, detail string, n_events int"
FULL = TAGGED + ", events array<struct<" + EVENT.replace(" ", ":").replace(",:", ",") + ">>"
EVENT_TYPES = [pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.float64()]
#: Scores that are in Python at once; a batch of Spark's may hold thousands.
AT_ONCE = 64
#: Events after which those of whole scores go back to Spark.
ROWS_OUT = 10_000


def listed(counts: list[int], columns: list[list], names: list[str], types: list[pa.DataType]) -> pa.ListArray:
    """A list of structs for each count, from the values of all of them end to end."""
    ends = [0]
    for n in counts:
        ends.append(ends[-1] + n)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names))


def parse_files(files: DataFrame, least: int = 32, events: bool = True) -> DataFrame:
    """``(piece_id, status, reason, detail, n_events, events)`` of ``(piece_id, content)``.

    A file that can't be read becomes an exclusion with reason ``parse_error``, one with fewer than
    ``least`` events with ``too_short``; no file fails the job. Without ``events`` every file is
    parsed all the same, but what it holds stays in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield told(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns))

    def told(pieces: list, contents: list) -> pa.RecordBatch:
        rows, counts, found = [], [], []
        for piece, content in zip(pieces, contents):
            counts.append(0)
            try:
                of_file = parse(bytes(content) if not isinstance(content, str) else content.encode())
            except Exception as error:  # whatever a file holds, it is recorded
                rows.append((piece, "excluded", "parse_error", f"{type(error).__name__}: {error}"[:200], 0))
                continue
            if len(of_file) < least:
                rows.append((piece, "excluded", "too_short", f"{len(of_file)} events", len(of_file)))
            else:
                rows.append((piece, "prepared", None, None, len(of_file)))
                if events:
                    counts[-1] = len(of_file)
                    found += of_file
        names = [f.split(" ")[0] for f in TAGGED.split(", ")]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 4 + [pa.int32()])]
        if events:
            names.append("events")
            columns.append(listed(counts, list(zip(*found)) or [[]] * len(EVENT_FIELDS), EVENT_FIELDS, EVENT_TYPES))
        return pa.RecordBatch.from_arrays(columns, names)

    return files.select("piece_id", "content").mapInArrow(run, FULL if events else TAGGED)


def write_files(scores: DataFrame) -> DataFrame:
    """``(piece_id, content)`` of ``(piece_id, events)``, events with ``offset``, ``duration`` and ``midi_pitches`` in the order in which they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(at, AT_ONCE)
                ends = [0]
                for n in rows["events"].value_lengths().to_pylist():
                    ends.append(ends[-1] + n)
                held = rows["events"].flatten()
                by = dict(zip((f.name for f in held.type), held.flatten()))
                flat = list(zip(*(by[f].to_pylist() for f in ("offset", "duration", "midi_pitches"))))
                texts = [write(flat[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([rows["piece_id"], pa.array(texts, pa.string())], ["piece_id", "content"])

    return scores.select("piece_id", "events").mapInArrow(run, "piece_id string, content string")


def rewritten(events: DataFrame, least: int = 32) -> DataFrame:
    """``(piece_id, *EVENT)``: every score written from its events and parsed again, those with ``least`` events at least.

    ``events`` are rows of ``(piece_id, t, offset, duration, midi_pitches)``, those of a piece in one
    partition. A task sorts them by score and holds the events of one score besides a batch of
    rows, however many scores it has. Events without pitches come back as rests. A score that can't
    be written or read again is an error of this module and fails the job: left out, it would look
    like one that is too short.
    """
    names = ["piece_id", *EVENT_FIELDS]
    types = [pa.string(), *EVENT_TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        for piece, score in scores(batches):
            try:
                rows = parse(write(score).encode(), rests=True)
            except Exception as error:
                raise ValueError(f"score {piece} can't be written and read again: {type(error).__name__}: {error}") from error
            if len(rows) >= least:
                out[0] += [piece] * len(rows)
                for column, values in zip(out[1:], zip(*rows)):
                    column += values
            if len(out[0]) >= ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return events.select("piece_id", "t", "offset", "duration", "midi_pitches").sortWithinPartitions("piece_id", "t").drop("t").mapInArrow(run, "piece_id string, " + EVENT)


def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """Each piece with its events, from rows in order of the pieces; one may go on in the next batch."""
    piece, held = None, []
    for batch in batches:
        ids, *columns = (c.to_pylist() for c in batch.columns)
        for name, own in itertools.groupby(zip(ids, *columns), operator.itemgetter(0)):
            if held and name != piece:
                yield piece, held
                held = []
            piece = name
            held += [row[1:] for row in own]
    if held:
        yield piece, held


def read_scores(spark: SparkSession, root: str, least: int = 32) -> DataFrame:
    """:func:`parse_files` of every score file below ``root``; the id is the path below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    scores = files.where(F.lower("path").rlike(r"\.(xml|musicxml|mxl)$"))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    piece = F.regexp_replace("path", "^.*?" + base.replace(".", r"\.") + "/", "")
    # parsing times are heavy-tailed, so files are spread by a hash of their path
    return parse_files(scores.select(piece.alias("piece_id"), "content").repartition("piece_id"), least)


def exploded(parsed: DataFrame) -> DataFrame:
    """The events of prepared pieces, one a row."""
    return parsed.where("status = 'prepared'").select("piece_id", F.inline("events"))
