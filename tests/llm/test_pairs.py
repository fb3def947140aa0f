"""Operators on pieces: overlaps, near duplicates, shared spans, groups and splits."""

import datetime as dt
import random

import numpy as np
import pytest

from scorelake.llm import p01_split_overlap as p1
from scorelake.llm import p03_near_duplicates as p3
from scorelake.llm import p04_shared_spans as p4
from scorelake.llm import p07_grouped_splits as p7
from scorelake.llm.common import shingles

PREPARED = "piece_id string, source_path string, title string, canonical_work_id string, tokens array<int>, prepared_at timestamp, split string, class_id int, n int"
RECORDS = "piece_id string, split string, registered_at timestamp, title string, e string, t int"
DAY = dt.datetime(2024, 1, 1)


def fives(tokens):
    return {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)}


def prepared(spark, pieces, works=None, paths=None):
    rows = [(k, (paths or {}).get(k), None, (works or {}).get(k), v, DAY, "x", 1, 2) for k, v in pieces.items()]
    return spark.createDataFrame(rows + rows[:2], PREPARED)


def records(spark, splits):
    rows = [(k, s, DAY, None, "e", 1) for k, s in splits.items()]
    late = [(k, "nonsense", DAY - dt.timedelta(days=1), None, "e", 1) for k in splits]
    return spark.createDataFrame(rows + late + rows[:1] + [(None, "train", DAY, None, "e", 1)], RECORDS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    out = {}
    for i in range(60):
        base = [rng.randrange(60) for _ in range(rng.randrange(40, 160))]
        out[f"s/{i:03d}"] = base
        if i % 3 == 0:
            edited = base[:]
            for _ in range(rng.randrange(1, 5)):
                edited[rng.randrange(len(edited))] = rng.randrange(60)
            out[f"s/{i:03d}e"] = edited
        if i % 5 == 0:
            cut = rng.randrange(5, 30)
            out[f"s/{i:03d}m"] = base[cut:] + base[:cut]
        if i % 7 == 0:
            out[f"s/{i:03d}c"] = base[:]
    out["s/run"] = [7] * 50
    out["s/run2"] = [7] * 70
    out["s/run3"] = [3] * 5 + [7] * 33 + [4, 5] * 20
    out["s/short"] = [1, 2, 3]
    out["s/empty"] = []
    return out


SPLITS = ["train", " Train ", "TEST", "val", "valid", "validation", None, ""]


def test_split_overlap_is_exact(spark, corpus):
    splits = {k: SPLITS[(i * 5) % len(SPLITS)] for i, k in enumerate(corpus)}
    norm = {k: {"val": "validation", "valid": "validation"}.get((s or "").strip().lower(), (s or "").strip().lower()) for k, s in splits.items()}
    want = set()
    for e in corpus:
        for t in corpus:
            if e != t and norm[t] == "train" and norm[e] in ("validation", "test") and fives(corpus[e]):
                if len(fives(corpus[e]) & fives(corpus[t])) * 5 >= 4 * len(fives(corpus[e])):
                    want.add(tuple(sorted((e, t))))
    got = {tuple(r) for r in p1.found(prepared(spark, corpus), records(spark, splits)).collect()}
    assert want and got == want


def test_near_duplicates_reach_recall(spark, corpus):
    want = set()
    names = sorted(corpus)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = fives(corpus[a]), fives(corpus[b])
            if x and y and len(x & y) >= 0.6 * len(x | y):
                want.add((a, b))
    got = {tuple(r) for r in p3.found(prepared(spark, corpus)).collect()}
    assert want and got == want
    # tiny nodes force deep branching and the comparison at the last level
    got = {tuple(r) for r in p3.found(prepared(spark, corpus), node_limit=2, max_depth=3).collect()}
    assert got == want


def test_groups_cover_every_piece(spark, corpus):
    rows = {r["piece_id"]: r["group_id"] for r in p3.groups(prepared(spark, corpus)).collect()}
    assert set(rows) == {k for k, t in corpus.items() if len(t) >= 5}
    assert rows["s/000"] == rows["s/000c"]


def shared_stretches(corpus, length):
    where = {}
    for k, t in corpus.items():
        for i in range(len(t) - length + 1):
            where.setdefault(tuple(t[i : i + length]), set()).add(k)
    out = set()
    for k, t in corpus.items():
        hit = [False] * (len(t) + 1)
        for i in range(len(t) - length + 1):
            if len(where[tuple(t[i : i + length])]) > 1:
                hit[i : i + length] = [True] * length
        start = None
        for i, h in enumerate(hit):
            if h and start is None:
                start = i
            if not h and start is not None:
                out.add((k, start, i))
                start = None
    return out


@pytest.mark.parametrize("length", [8, 16, 32, 45])
def test_shared_spans_are_exact(spark, corpus, length):
    got = {tuple(r) for r in p4.spans(prepared(spark, corpus), length).collect()}
    want = shared_stretches(corpus, length)
    assert want and got == want


def symbols_of(tokens, length):
    """The rounds on records of one process, with a plain dictionary as the naming: symbols, windows and zones."""
    lengths = np.array([len(t) for t in tokens])
    symbols, windows, lo, hi = p4.begun(np.concatenate(tokens), lengths, length)
    names = {}
    for r, step in enumerate(p4.rounds_for(length)):
        lo, hi = symbols.zone(*step, r, lo, hi)
        symbols, at, first, second = symbols.marked(*step, r)
        for i, a, b in zip(at, first.tolist(), second.tolist()):
            symbols.name[i] = names.setdefault((r, a, b), (1 << 40) + len(names))
    return symbols, windows, lo, hi


def test_every_window_keeps_an_inner_symbol():
    rng = np.random.default_rng(1)
    for length in (12, 20, 32, 64):
        for alphabet in (1, 2, 3, 60):
            inner = p4.Inner(*symbols_of([rng.integers(0, alphabet, 400), rng.integers(0, alphabet, 90)], length))
            assert (inner.width >= 1).all()


def test_names_stand_for_one_string_of_tokens():
    rng = np.random.default_rng(3)
    tokens = np.concatenate([rng.integers(0, 2, 300), np.zeros(40, np.int64)])
    symbols = symbols_of([tokens], 32)[0]
    assert symbols.size.sum() == len(tokens) and symbols.size.max() > 2
    seen = {}
    for name, start, size in zip(symbols.name, symbols.start, symbols.size):
        assert seen.setdefault(name, tuple(tokens[start : start + size])) == tuple(tokens[start : start + size])


def test_equal_windows_have_equal_inner_symbols():
    rng = np.random.default_rng(2)
    for alphabet in (1, 2, 4):
        w = rng.integers(0, alphabet, 32)
        texts = [np.r_[rng.integers(0, alphabet, rng.integers(0, 9)), w, rng.integers(0, alphabet, 5)] for _ in range(20)]
        symbols, windows, lo, hi = symbols_of(texts, 32)
        inner, seen = p4.Inner(symbols, windows, lo, hi), set()
        for k, t in enumerate(texts):
            at = next(i for i in range(len(t) - 31) if (t[i : i + 32] == w).all())
            i = np.flatnonzero(windows == k)[at]
            seen.add(tuple(symbols.name[inner.first[i] : inner.last[i] + 1]))
        assert len(seen) == 1


def test_shared_share_counts_tokens(spark):
    t = list(range(40))
    rows = {r["piece_id"]: (r["n_tokens"], r["n_shared"]) for r in p4.shared_share(prepared(spark, {"a": t, "b": [59] * 3 + t, "c": [1]})).collect()}
    assert rows == {"a": (40, 40), "b": (43, 40), "c": (1, 0)}


def test_split_groups(spark):
    tokens = {k: [1] for k in "abcdefg"}
    works = {"a": "X_y-Z", "b": " x y.z ", "c": None, "d": "", "e": "q", "f": "Q", "g": "r"}
    paths = {"b": "/p", "c": "/p", "d": "/r", "e": "/s"}
    table = prepared(spark, tokens, works, paths)
    splits = {"a": "train", "c": "test", "e": "train", "f": None, "g": "val"}
    got = {r["piece_id"] for r in p7.found(table, records(spark, splits)).collect()}
    assert got == {"a", "b", "c"}
    placed = {r["piece_id"]: r["new_split"] for r in p7.assign(table).collect()}
    assert set(placed) == set(tokens) and len({placed[k] for k in "abc"}) == 1 and placed["e"] == placed["f"]


def test_largest_differencing_is_whole_and_level():
    rng = random.Random(5)
    weights = {}
    for _ in range(500):
        w = rng.randrange(1, 40)
        weights[w] = weights.get(w, 0) + 1
    held = p7.largest_differencing(weights, 20)
    total = {}
    for b in held:
        for w, c in b.items():
            total[w] = total.get(w, 0) + c
    assert total == weights
    loads = [sum(w * c for w, c in b.items()) for b in held]
    assert max(loads) - min(loads) <= 2
    plan = p7.allocate(weights)
    share = plan.assign(n=(plan.to_rank - plan.from_rank) * plan.weight).groupby("split").n.sum() / sum(w * c for w, c in weights.items())
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01


def test_empty_tables(spark):
    none, nobody = spark.createDataFrame([], PREPARED), spark.createDataFrame([], RECORDS)
    nulls = spark.createDataFrame([(None,) * 9, ("a", None, None, None, None, None, None, None, None)], PREPARED)
    for table in (none, nulls):
        assert p1.found(table, nobody).collect() == []
        assert p1.report(table, nobody).collect() == []
        assert p3.found(table).collect() == []
        assert p4.spans(table).collect() == []
        assert p7.found(table, nobody).collect() == []
    assert p7.assign(none).collect() == []


def test_null_and_large_tokens(spark):
    big = [None, 5000, 1, None, 2, 70000] * 12
    table = prepared(spark, {"a": big, "b": big[:], "c": [9] * 40})
    assert {tuple(r) for r in p3.found(table).collect()} == {("a", "b")}
    assert {tuple(r) for r in p4.spans(table).collect()} == {("a", 0, 72), ("b", 0, 72)}
    assert len(shingles([None, 1, 2, 3, 4])) == 1 and len(shingles([0, 1, 2, 3])) == 0


def test_hot_group_of_copies(spark):
    rng = random.Random(1)
    corpus = {f"c{i:03d}": [1, 2, 3, 4, 5, 6, 7, 8] * 5 for i in range(60)}
    corpus |= {f"d{i:03d}": [rng.randrange(60) for _ in range(50)] for i in range(120)}
    pairs = p3.found(prepared(spark, corpus)).collect()
    assert len(pairs) == 60 * 59 // 2
    splits = {k: "train" if int(k[1:]) % 2 else "test" for k in corpus}
    assert p1.found(prepared(spark, corpus), records(spark, splits)).count() == 30 * 30
