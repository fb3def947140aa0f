"""Variant spellings of names."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import p05_name_variants as p5
from scorelake.llm.names import Fuzzy, edit_distance

RECORDS = "piece_id string, composer string, title string, kind string, name string, block string"


def records(spark, composers, titles=()):
    rows = [(f"p{i}", c, None, "x", "y", "z") for i, c in enumerate(composers)] + [(f"q{i}", None, t, "x", "y", "z") for i, t in enumerate(titles)]
    return spark.createDataFrame(rows + rows[:3], RECORDS)


def linked(spark, composers, titles=()):
    return {(r["field"], r["name_a"], r["name_b"]) for r in p5.found(records(spark, composers, titles)).collect()}


def together(pairs, field, names):
    return all((field, *sorted((a, b))) in pairs for i, a in enumerate(names) for b in names[i + 1 :])


def test_composers(spark):
    one = ["Margaret Purakex", "Purakex, Margaret", "M. Purakex", "by Margaret Purakex", "MARGARET PURAKEX", "Peggy Purakex", "Margaret Q. Purakex", "Margaret Puraekx", "Purakex", "Margaret Purakex (1850-1912)", "Music: Margaret Purakex"]
    other = ["Harold Purakenx", "Samuel Pazidene", "Tobias Pazidene", "Unknown", "Anon.", "n/a", "", None, "Traditional"]
    ensemble = ["Gesudoley Folk Orchestra", "The Gesudoley Folk Orchestra", "Folk Orchestra of Gesudoley", "Folk Orchestra, Gesudoley", "Gesudoley Folk Orch."]
    got = linked(spark, one + other + ensemble)
    assert together(got, "composer", [n for n in one if n != "Purakex"]) and together(got, "composer", ensemble)
    names = {n for _, *p in got for n in p}
    assert not names & {"Samuel Pazidene", "Tobias Pazidene", "Unknown", "Anon.", "n/a", "", "Traditional"}


def test_titles(spark):
    one = ["Nocturne of the Hollow Kite at Fotedrustow No. 2", "Hollow Kite at Fotedrustow, Nocturne No. 2", "nocturne_of_the_hollow_kite_at_fotedrustow_no._2", "Nocturno of the Hollow Kite at Fotedrustow #2", "Noct. of the Holow Kite at Fotedrustow No. 2", "The Hollow Kite at Fotedrustow: Nocturne No. 2 (easy piano)"]
    other = ["Nocturne of the Hollow Kite at Fotedrustow No. 3", "Waltz of the Hollow Kite at Fotedrustow No. 2", "Nocturne No. 2", "Nocturne in B major", "Untitled", "Sheet music", None, "   "]
    got = linked(spark, [], one + other)
    assert together(got, "title", one) and not {n for _, *p in got for n in p} & set(other)


def test_pairs_are_ordered_and_once(spark):
    got = p5.found(records(spark, ["Zoë Adalin", "zoe adalin", "Adalin, Zoë"])).collect()
    assert len(got) == 3 and all(r["name_a"] < r["name_b"] for r in got)


def test_metric_join_equals_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 9))) for _ in range(150)}
    words |= {"".join(rng.choice("abcdefghij") for _ in range(20)) for _ in range(60)}
    words |= {w[:9] + w[10] + w[9] + w[11:] for w in words if len(w) == 20}
    rows = [("x", w) for w in sorted(words)] + [("y", w) for w in sorted(words)[:40]]
    for radius, cell, shrink in ((1, 8, 1), (2, 16, 2), (2, 1000, 4)):
        got = {tuple(r) for r in p5.metric_join(spark.createDataFrame(rows, "tag string, s string"), radius, cell=cell, fan_out=4, shrink=shrink).collect()}
        want = {(b, x, y, d) for b, x in rows for c, y in rows if b == c and x < y and (d := edit_distance(x, y, radius)) <= radius}
        assert want and got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=7), st.text("abc", max_size=7)), min_size=1, max_size=5))
def test_distances_of_many_pairs(pairs):
    (a, la), (b, lb) = p5.encode([x for x, _ in pairs]), p5.encode([y for _, y in pairs])
    assert p5.distances(a, la, b, lb).tolist() == [edit_distance(x, y) for x, y in pairs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd", min_size=4, max_size=9), min_size=1, max_size=12), st.text("abcd", min_size=4, max_size=9))
def test_fuzzy_look_up_misses_nothing(words, token):
    want = sorted((d, w) for w in set(words) if (d := edit_distance(token, w)) <= (2 if len(w) >= 7 and len(token) > 4 else 1))
    assert Fuzzy(words).near(token) == ([(0, token)] if token in words else want)


def test_names_outside_the_lexicon(spark):
    one = ["Oyelaran Adekubello", "Adekubello, Oyelaran", "O. Adekubello", "Oyelarn Adekubello", "OYELARAN ADEKUBELO", "Adekubello"]
    other = ["Mwangi Adekubello-Tan", "Siobhan Kjartansdo", "Siobhan Wexlington"]
    got = linked(spark, one + other)
    assert together(got, "composer", one) and not {n for _, *p in got for n in p} & set(other)
    table = spark.createDataFrame([("Oyelaran", "Laran"), ("Siobhan", None)], "given string, nickname string")
    rows = p5.found(records(spark, ["Laran Adekubello", "Oyelaran Adekubello", "Adekubello Oyelaran"]), lexicon=table).collect()
    assert len(rows) == 3


def test_copies_change_no_link(spark):
    names = ["Margaret Purakexon", "Margaret Purkaexno", "Margaret Purakexo"]
    few, many = linked(spark, names), {(r["field"], r["name_a"], r["name_b"]) for r in p5.found(records(spark, names * 9)).collect()}
    assert few == many and len(few) == 3


def test_unread_form_joins_its_work(spark):
    got = linked(spark, [], ["Ballad of the Burning Caravan at Trestigaby", "Baiad of the Burning Caravan at Trestigaby", "Waltz of the Hollow Kite at Trestigaby"])
    assert {p[:1] + p[1:] for p in got} == {("title", "Baiad of the Burning Caravan at Trestigaby", "Ballad of the Burning Caravan at Trestigaby")}


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_edit_distance_is_a_metric(a, b, c):
    assert edit_distance(a, b) == edit_distance(b, a) and (edit_distance(a, b) == 0) == (a == b)
    assert edit_distance(a, c) <= edit_distance(a, b) + edit_distance(b, c)
    for limit in (1, 2):
        assert min(edit_distance(a, b), limit + 1) == edit_distance(a, b, limit)


def test_edit_distance_counts_a_swap_once():
    assert edit_distance("ca", "abc") == 2 and edit_distance("purakex", "puraekx") == 1


def test_empty(spark):
    assert p5.found(spark.createDataFrame([], RECORDS)).collect() == []
    assert p5.found(records(spark, [None, "", "?", "42"], ["", None, "No. 3", "☃"])).collect() == []
