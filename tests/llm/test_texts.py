"""Operators on texts: containers, mixing and personal data."""

import random

import numpy as np
import pytest

from scorelake.llm import p08_containers as p8
from scorelake.llm import p09_mixing as p9
from scorelake.llm import p10_personal_data as p10
from scorelake.llm.tokens import encoder, vocabulary_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, cluster string, size int, block int, part int"


def documents(spark, texts, source="forum"):
    return spark.createDataFrame([(i, t, None, source(i) if callable(source) else source, None, "c", 1, 2, 3) for i, t in enumerate(texts)], DOCS)


def test_best_fit_is_tight_and_keeps_copies_apart():
    rng = random.Random(2)
    items = [(rng.randrange(0, 60), rng.randrange(3), rng.randrange(400)) for _ in range(1500)]
    items += [(20, 0, 9999)] * 100
    placed, room = p8.best_fit(items, 100, {0: 0b010, 1: 0b001})
    used, sources, clusters = [0] * len(room), [set() for _ in room], [[] for _ in room]
    for (size, source, cluster), b in zip(items, placed):
        used[b] += size
        sources[b].add(source)
        clusters[b].append(cluster)
    assert all(u + r == 100 and r >= 0 for u, r in zip(used, room))
    assert all(not {0, 1} <= s for s in sources) and all(len(c) == len(set(c)) for c in clusters)
    loose, rest = p8.best_fit([(rng.randrange(1, 50), 0, i) for i in range(3000)], 100)
    assert sum(rest) - rest[-1] < 0.01 * 100 * len(rest)


def test_fill_places_every_text_once(spark):
    rng = random.Random(1)
    words = "bar coda clef harp minor slur tie rest beat".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))) for _ in range(120)]
    texts += [None, "", "  ", "same text", "Same  text", " ".join(words * 400)]
    encode = encoder(vocabulary_path()).encode_ordinary
    rows = p8.fill(documents(spark, texts)).collect()
    per, bins = {}, {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append((r["part"], r["start_token"], r["n_tokens"]))
        if r["container"]:
            bins.setdefault(r["container"], []).append(r)
    for i, t in enumerate(texts):
        n = len(encode(t)) if t is not None else 0
        parts = sorted(per[i])
        assert sum(p[2] for p in parts) == n and (len(parts) == 1 or n > 1024)
        assert all(p[1] == 1024 * p[0] for p in parts)
    assert all(sum(r["n_tokens"] for r in b) + b[0]["room_left"] == 1024 for b in bins.values())
    assert not any({123, 124} <= {r["doc_id"] for r in b} for b in bins.values())
    one = p8.summary(documents(spark, texts)).first()
    assert one["n_containers"] == len(bins) and one["total_room"] == 1024 * len(bins) - one["total_tokens"]


def test_duplicate_clusters_and_apart(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    near = base[:60] + ["other"] + base[61:]
    texts = [" ".join(base), " ".join(near).upper(), " ".join(rng.choice(words) for _ in range(120)), "", None, "too short", "Too  short", "☃"]
    got = {r["doc_id"]: r["cluster"] for r in p8.duplicate_clusters(documents(spark, texts)).collect()}
    assert set(got) == {0, 1, 2, 3, 5, 6, 7} and got[0] == got[1] != got[2] and got[5] == got[6]
    table = documents(spark, texts * 30, lambda i: "mail" if i % 3 else "Forum")
    one = p8.audit(table, apart=[("MAIL", "forum")]).first().asDict()
    assert one == {"n_documents": 240, "n_without_text": 240, "n_divided_small": 0, "n_wrong_room": 0, "n_duplicates_together": 0, "n_apart_together": 0} | {"n_without_text": 30}


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 17, 1000):
        x = p9.permuted(np.arange(n), np.full(n, n), np.full(n, 5))
        assert sorted(x) == list(range(n))
    assert (p9.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 6)) != x).any()


def test_mix_size_and_quotas():
    blocks, targets = {"a": 1000, "b": 50, "c": 500}, {"a": (0.5, 1), "b": (0.2, 4), "c": (0.2, 2), "none": (0.1, 3)}
    share = p9.usable_shares(blocks, targets)
    assert "none" not in share and abs(sum(share.values()) - 1) < 1e-12
    n = p9.mix_size(blocks, targets, 0.0)
    assert abs(n - 200 * 0.9 / 0.2) <= 1
    assert p9.quotas(share, {"a": 1000, "b": 200, "c": 1000}, n) == {"a": round(n * 5 / 9), "b": 200, "c": 200}
    # a scarce source of little weight doesn't bound the mix
    tiny = blocks | {"d": 1}, targets | {"d": (0.001, 1)}
    assert p9.mix_size(*tiny, 0.0) < 1100 and p9.mix_size(*tiny, 0.01) > 900
    assert p9.mix_size({}, targets, 0.0) == 0 and p9.usable_shares({}, targets) == {}


def test_plan_of_two_thousand_million_slots(spark):
    share, slots = {"a": 0.5, "b": 0.3, "c": 0.2}, 2_000_000_000
    plan = p9.drawn_counts(spark, share, slots, 2_000_000, 5).cache()
    rows = plan.collect()
    assert sum(r["count"] for r in rows) == slots and len({r["shard"] for r in rows}) == 1000
    at = {}
    for r in sorted(rows, key=lambda r: r["shard"]):
        assert r["first"] == at.get(r["source"], 0)
        at[r["source"]] = r["first"] + r["count"]
    assert all(abs(at[s] / slots - p) < 1e-4 and at[s] != p * slots for s, p in share.items())  # drawn, not dealt
    assert {(r["shard"], r["count"]) for r in p9.drawn_counts(spark, share, slots, 2_000_000, 5).collect()} == {(r["shard"], r["count"]) for r in rows}


def test_levelled_slots_fill_the_quotas(spark):
    share, most = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 900, "b": 900, "c": 150}
    plan = p9.drawn_counts(spark, share, 1000, 64, 5)
    rows, quota = p9.levelled(plan, share, most, 1000)
    got = {}
    for r in rows.collect():
        got.setdefault(r["source"], []).append(r["k"])
    assert quota == {"a": 500, "b": 300, "c": 150}
    assert all(sorted(ks) == list(range(quota[s])) for s, ks in got.items())


def test_mix_covers_tokens(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("coda clef harp tie".split()) for _ in range(rng.randrange(20, 200))) for _ in range(300)] + [None, ""]
    table = documents(spark, texts, lambda i: "Forum" if i % 3 else "errata" if i % 2 else None)
    targets = spark.createDataFrame([("forum", 0.6, 1), ("ERRATA", 0.3, 3), ("diary", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = p9.mix(table, targets, block=64, per_shard=16, per_range=8).collect()
    seen = {}
    for r in rows:
        for k in range(r["start_token"], r["start_token"] + r["n_tokens"]):
            seen[r["doc_id"], k, r["source"]] = seen.get((r["doc_id"], k, r["source"]), 0) + 1
    assert max(n for (_, _, s), n in seen.items() if s == "forum") == 1 and max(n for (_, _, s), n in seen.items() if s == "errata") <= 3
    assert len({(r["shard"], r["slot"]) for r in rows}) == len({(r["shard"], r["slot"], r["source"], r["block"]) for r in rows})
    share = {r["source"]: r for r in p9.shares(table, targets, block=64, per_shard=16, per_range=8).collect()}
    assert abs(share["forum"]["share"] - 2 / 3) < 0.03 and share["diary"]["n_tokens"] == 0
    assert p9.mix(documents(spark, []), targets).collect() == []


CASES = [
    ("Write to <bob.rilay+x@mx2.songbook.test> now.", "email", "bob.rilay+x@mx2.songbook.test"),
    ("ping ofa.peidze[at]mx2[dot]songbook[dot]test.", "email", "ofa.peidze[at]mx2[dot]songbook[dot]test"),
    ("Escriba a tnareo at millchoir dot example para", "email", "tnareo at millchoir dot example"),
    ("or anouk-denimond (at) example.org. Next", "email", "anouk-denimond (at) example.org"),
    ("Contacto: lupe @ quartet.test Nadie", "email", "lupe @ quartet.test"),
    ("Call +44 (0)20 7946 0317 for hire", "phone", "+44 (0)20 7946 0317"),
    ("mobile is +1 604 555 0121, evenings", "phone", "+1 604 555 0121"),
    ("Tel. 0049/30/23125992 Bar", "phone", "0049/30/23125992"),
    ("Call (341) 555-0166 for", "phone", "(341) 555-0166"),
    ("on +49 30 23125-872 or", "phone", "+49 30 23125-872"),
    ("DNI 99.053.192-N, pago", "id_number", "99.053.192-N"),
    ("ID: QQ 26 99 15 D, page", "id_number", "QQ 26 99 15 D"),
    ("security no. 995-26-7711 was", "id_number", "995-26-7711"),
    ("Ausweis 948318030 (siehe", "id_number", "948318030"),
    ("copies to Flat 5, 220 Benemouth Avenue, Kabudrohurst.\nThe", "address", "Flat 5, 220 Benemouth Avenue, Kabudrohurst"),
    ("address: 66B Tretaridge Rd., Nolatrobridge QZ8 6XX I", "address", "66B Tretaridge Rd., Nolatrobridge QZ8 6XX"),
    ("at P.O. Box 3169, Trustitrucombe. We", "address", "P.O. Box 3169, Trustitrucombe"),
    ("en C/ Mirobridge, 89, 99031 Gutratishaw. La", "address", "C/ Mirobridge, 89, 99031 Gutratishaw"),
    ("en Calle del Nostibury 186, 2º B. Esta", "address", "Calle del Nostibury 186, 2º B"),
    ("a Plaza Rufowick s/n, Fogasagarth.", "address", "Plaza Rufowick s/n, Fogasagarth"),
    ("in Kemobrookstr. 103.\nBitte", "address", "Kemobrookstr. 103"),
    ("an Am Zugiport 79a, 00332 Gikeraend senden", "address", "Am Zugiport 79a, 00332 Gikeraend"),
    ("Thanks to Dr. Trifen, Lola for the scan", "person_name", "Trifen, Lola"),
    ("by Friedrich de la Zokirg, phone", "person_name", "Friedrich de la Zokirg"),
    ("payee L.E. O'Drihazietti, x", "person_name", "L.E. O'Drihazietti"),
    ("(accordion: alexander vagofoet; flute)", "person_name", "alexander vagofoet"),
    ("Transcripción de Gohosk, Guadalupe.", "person_name", "Gohosk, Guadalupe"),
    ("ZOË DIBOSOESQUE <x>", "person_name", "ZOË DIBOSOESQUE"),
    ("sent by Thomas Miller yesterday", "person_name", "Thomas Miller"),
    ("la carta de Maria Lopez llegó", "person_name", "Maria Lopez"),
    ("thanks to Mrs. Oyelaran Adekunle Bello for", "person_name", "Oyelaran Adekunle Bello"),
    ("tax no. 123456789 was", "id_number", "123456789"),
    ("Tel. +33 1 44 55 66 77, nachmittags", "phone", "+33 1 44 55 66 77"),
    ("en Calle Mayor 7, 28001 Las Palmas.", "address", "Calle Mayor 7, 28001 Las Palmas"),
]


@pytest.mark.parametrize("text, kind, want", CASES)
def test_places_are_found(text, kind, want):
    assert [text[a:b] for k, a, b in p10.find(text) if k == kind] == [want]


CLEAN = [
    "ISMN 979-0-0000-4444-2 is on the cover.", "The plate number H. 387-7328 belongs to an older print.", "Shelf mark LSB 5695-12 covers the set.",
    "Play the refrain @ 173 first, then without.", "See https://scores.example/p/9289429 for the scan.", "Duration 00:53:45, recorded in a calm hall.",
    "Humoresque of the Golden Kite at Lopikowold No. 3", "The file was exported on 04.03.2019.", "7º B. Transcripción lista.", "Token counts rose from 5826 to 7813246.",
]


@pytest.mark.parametrize("text", CLEAN)
def test_other_numbers_and_titles_are_left(text):
    assert p10.find(text) == []


def test_pseudonyms_keep_format_and_link():
    key = b"k"
    for value in ("+44 20 7946 0271", "99.387.491-Y", "07700 900355", "12", "7"):
        fresh = p10.permute_number(value, key)
        assert len(fresh) == len(value) and [c.isdigit() for c in fresh] == [c.isdigit() for c in value]
        assert p10.permute_number(fresh, key, undo=True) == value
    assert len({p10.permute_digits(f"{i:03d}", key) for i in range(1000)}) == 1000
    assert p10.permute_date(p10.permute_date("1984-02-29", key), key, undo=True) == "1984-02-29"
    assert p10.permute_date("31.02.1984", key) == "31.02.1984"
    for value in ("12345678Z", "X1234567L", "12345678A", "86095742719", "86095742710", "123456789", "995267711", "QQ269915D"):
        fresh = p10.permute_identity(value, key)
        assert p10.read_identity(fresh) == p10.read_identity(value) and p10.permute_identity(fresh, key, undo=True) == value
    assert p10.read_identity("12345678Z") == ("national", True) and p10.read_identity("12345678A") == ("national", False)
    assert p10.read_identity("X1234567L") == ("foreigner", True) and p10.read_identity("86095742719") == ("tax", True)
    assert p10.read_identity("123-45-6789") == ("social", True) and p10.read_identity("995-26-7711") == ("social", False)
    assert len({p10.permute_below(i, 700, key, like=lambda x: x % 2) for i in range(700)}) == 700
    assert p10.redact("on 29.02.1984.", key, dates=True).startswith("on <DATE ") and p10.redact("on 29.02.1984.", key) == "on 29.02.1984."
    a, b = p10.redact("Tel. +44 20 7946 0271", key), p10.redact("call +44 20 7946 0271 now", key)
    assert a.split("<")[1] == b.split("<")[1].split(" now")[0] and a.startswith("Tel. <PHONE ")


def test_found_and_redacted(spark):
    text = "Reply to Pat Usivox, phone 020 7946 0353.\r\n" * 3
    long = "plain words " * 30_000 + "Contact: ted+scores@quartet.test"
    table = documents(spark, [text, None, "", "x", long])
    got = sorted(tuple(r) for r in p10.found(table, "k").collect())
    assert [g[1] for g in got if g[0] == 0].count("phone") == 3 and (4, "email", 360_009, 360_032) in got
    rows = {r["doc_id"]: r for r in p10.redacted(table, "k").collect()}
    assert rows[1]["text"] is None and rows[2]["text"] == "" and "7946" not in rows[0]["text"] and rows[0]["n_places"] == 6
    assert p10.found(documents(spark, []), "k").collect() == []
    marked = {(r["kind"], r["valid"]) for r in p10.places(documents(spark, ["DNI 12345678Z and 12345678A"]), "k").collect()}
    assert marked == {("id_number", True), ("id_number", False)}
    with pytest.raises(ValueError):
        p10.redacted(table, "")
