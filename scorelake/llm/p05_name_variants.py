"""Problem 5: variant spellings of names typed by people.

Spellings are first read into parts (given name and surname, kind and place of an ensemble,
form, number and core of a title). Cores are joined in a metric space: unrestricted
Damerau-Levenshtein distance between cores, no finite distance between different tags (a title's
form and number, an ensemble's kind words; people have one tag). Pivots are drawn from every tag,
each string goes to the cell of its nearest pivot and is replicated to every earlier cell whose
pivot is at most twice the radius farther (triangle inequality), large cells are partitioned
again, and each cell runs an exact radius join in chunks of bounded size. Linked parts form
entities by connected components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import merged
from scorelake.llm.names import PARTICLES, Fuzzy, Lexicon, fold
from scorelake.operators.components import connected_components
from scorelake.session import cut_lineage

#: Names that name nobody and titles that name nothing.
PLACEHOLDERS = frozenset(
    "unknown anon anonymous anonymus anonimo traditional trad tradicional traditionell various composer na none null "
    "untitled score sheet music notes sin titulo ohne titel no title title desconocido unbekannt volksweise".split()
)
#: Kinds of ensembles, and how their words are abbreviated.
ENSEMBLE = frozenset(
    "ensemble choir choral chorus orchestra society quartet quintet trio band press consort singers philharmonic symphony "
    "wind chamber string folk music brass".split()
)
ENSEMBLE_HEADS = frozenset("ensemble choir chorus orchestra society quartet quintet trio band press consort singers philharmonic symphony".split())
SHORT = {"ens": "ensemble", "orch": "orchestra", "soc": "society", "ch": "chamber", "qt": "quartet", "chor": "choral", "str": "string", "phil": "philharmonic", "mus": "music", "pr": "press"}
#: Form words in other languages, and their abbreviations.
FORMS = {
    "ballad": "ballad ballade balada bal", "nocturne": "nocturne nocturno notturno noct", "sonata": "sonata sonate son",
    "minuet": "minuet menuett menuet minueto minuetto min", "waltz": "waltz walzer vals valse wlz",
    "prelude": "prelude preludio praludium prel", "fantasia": "fantasia fantasie fantasy phantasie fant",
    "rondo": "rondo rondeau rdo", "humoresque": "humoresque humoreske humoresca humor", "serenade": "serenade serenata ser",
    "march": "march marsch marcha marche mch", "hymn": "hymn hymne himno hy", "lullaby": "lullaby wiegenlied nana lull",
    "pavane": "pavane pavana pav", "berceuse": "berceuse berc", "tarantella": "tarantella tarantela tar",
    "songbook": "songbook liederbuch cancionero", "etude": "etude estudio etud", "mazurka": "mazurka maz", "polonaise": "polonaise pol",
}
FORM_OF = {word: form for form, words in FORMS.items() for word in words.split()}
STOP = frozenset("the of at a an in for and de la el le der die das und y no nr num op".split())
KEY_WORDS = frozenset("major minor dur moll mayor menor flat sharp a b c d e f g h bemol sostenido re mi fa sol la si do".split())
#: Words that tell how a work was arranged.
ARRANGED = frozenset(
    "easy solo simple simplified full arr arranged arrangement transcription transcribed version duet for by piano guitar violin "
    "cello flute viola harp oboe horn clarinet voice choir facil leicht beginner beginners".split()
)
TAIL = re.compile(r"\s*(?:\(([^()]*)\)|\[([^\[\]]*)\]|\s[-–—]\s*([^-–—]*))\s*$")


_ARRANGED, _FORMS, _ENSEMBLE = Fuzzy(ARRANGED, long=99, shortest=3), Fuzzy(FORM_OF), Fuzzy(ENSEMBLE, long=99)


def arranged(word: str) -> bool:
    return bool(_ARRANGED.near(word))


def without_arrangement(text: str) -> str:
    """A folded title without a tail in brackets or after a dash that tells an arrangement."""
    tail = TAIL.search(text)
    words = re.findall(r"[^\W_]+", next((g for g in tail.groups() if g is not None), "")) if tail else []
    return text[: tail.start()] if words and all(map(arranged, words)) else text


def form_of(word: str) -> str | None:
    """The form a folded word names, allowing for one typo, or two in forms of seven letters or more."""
    near = [(d, FORM_OF[w]) for d, w in _FORMS.near(word)]
    return near[0][1] if near and all(f == near[0][1] for d, f in near if d == near[0][0]) else None


_SHORT_STOP = Fuzzy(("the", "of", "at"), least=1, long=99, shortest=1)


def stop_word(word: str) -> bool:
    """A word of no weight in a title, also with one typo in the commonest ones."""
    if word in STOP or word in ("thhe", "thee", "tthe"):
        return True
    return len(word) <= 3 and bool(_SHORT_STOP.near(word))


def ensemble_word(word: str) -> str | None:
    if word in SHORT:
        return SHORT[word]
    near = _ENSEMBLE.near(word)
    return near[0][1] if len(near) == 1 else None


def read_composer(name: str, lexicon: Lexicon) -> tuple[str, str, str, str] | None:
    """``(kind, rest, core, '')`` of a composer's spelling, or None for a placeholder.

    kind ``org``: rest is the sorted kind words, core the place. kind ``full``: rest is the given
    name or nickname, core the surname. kind ``part``: rest is the letters known of the given
    name (maybe none), core the surname.
    """
    text = fold(name).replace("’", "'")
    text = re.sub(r"\(.*?\)|\[.*?\]|\b\d{3,4}.?\d{0,4}\b", " ", text)
    text = re.sub(r"^\s*(?:by|music|musica|musik|composed by|comp\.?|words and music|de|von)\b\s*(?::|(?<=by)\s)\s*", "", text)
    text = re.sub(r"^\s*(?:music|musica|musik)\s*:\s*", "", text)
    parts = [re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?\.?", p.replace("-", " ").replace("_", " ")) for p in text.split(",")]
    parts = [p for p in parts if p]
    words = [w.rstrip(".") for p in parts for w in p]
    if not words or all(w in PLACEHOLDERS for w in words) or "".join(words) in ("na", "nn"):
        return None
    kinds = [ensemble_word(w) for w in words]
    if len(words) > 1 and any(k in ENSEMBLE_HEADS for k in kinds if k):
        place = [w for w, k in zip(words, kinds) if not k and w not in STOP]
        kind = sorted({k for k in kinds if k})
        return ("org", " ".join(kind), " ".join(place), "") if place else None
    if len(parts) == 2:
        words = [w.rstrip(".") for w in parts[1] + parts[0]]
        dotted = {w.rstrip(".") for w in parts[1] if w.endswith(".")}
    else:
        dotted = {w.rstrip(".") for p in parts for w in p if w.endswith(".")}
        if len(words) >= 2 and lexicon.known(words[-1]) in lexicon.given and lexicon.known(words[0]) is None and len(words[0]) > 2 and words[0] not in dotted:
            words = words[-1:] + words[:-1]  # surname first
    if len(words) == 1:
        return "part", "", words[0], ""
    given, rest = words[0], words[1:]
    while len(rest) > 1 and (len(rest[0]) == 1 or (rest[0] not in PARTICLES and rest[0] in lexicon.given)):
        rest = rest[1:]  # middle names and initials
    surname = " ".join(rest)
    if len(given) == 1 or given in dotted:
        return "part", given, surname, ""
    return "full", lexicon.known(given) or given, surname, ""


def read_title(title: str) -> tuple[str, str, str, str] | None:
    """``('title', form, core, number)`` of a title's spelling, or None if it names no work.

    If no form can be read, a first word followed by "of" is taken for one (kind ``unread``).
    """
    text = fold(title).replace("_", " ")
    text = without_arrangement(text)
    text = re.sub(r"\bst\.(?=\s|$)", "street", text)
    number = ""
    numbered = re.search(r"(?:\b(?:no|nr|num)\b\.?|\bn[°º]|#)\s*(\d+)", text)
    if numbered:
        number = numbered.group(1).lstrip("0") or "0"
        text = text[: numbered.start()] + " " + text[numbered.end() :]
    opus = re.search(r"\bop\.?\s*(\d+)", text)
    if opus:
        number += f"op{opus.group(1)}"
        text = text[: opus.start()] + " " + text[opus.end() :]
    words = re.findall(r"[^\W_]+", text)
    # the form stands first or last, or right before "of"
    order = [0, len(words) - 1, *range(1, len(words) - 1)] if words else []
    at = next((i for i in order if words[i] in FORM_OF), None)
    if at is None:
        at = next((i for i in order if form_of(words[i])), -1)
    form = form_of(words[at]) if at >= 0 else ""
    kind = "title"
    if at < 0 and len(words) > 2 and words[1] == "of":
        kind, at = "unread", 0
    kept = [w for i, w in enumerate(words) if i != at and not stop_word(w)]
    if all(w in KEY_WORDS or w in PLACEHOLDERS or w.isdigit() for w in kept):
        return None
    return kind, form, " ".join(kept), number


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(s) for s in strings), dtype=np.int64, count=len(strings))
    codes = np.zeros((len(strings), int(lengths.max(initial=1))), dtype=np.int32)
    for i, s in enumerate(strings):
        codes[i, : len(s)] = np.frombuffer(s.encode("utf-32-le"), dtype=np.int32)
    return codes, lengths


def distances(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray, most: int = 2_000) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of many pairs of code rows at once, a row of all tables at a time.

    ``a`` may be one row that stands against all of ``b``. At most ``most`` pairs are worked on
    together, so their tables stay in the processor's cache.
    """
    out = np.empty(len(b), dtype=np.int32)
    for at in range(0, len(b), most):
        part = slice(at, at + most)
        x, x_len = (a, a_len) if len(a) == 1 else (a[part], a_len[part])
        y_len = b_len[part]
        out[part] = _distances(x[:, : int(x_len.max(initial=0))], x_len, b[part][:, : int(y_len.max(initial=0))], y_len)
    return out


def _distances(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    n, width = b.shape
    step = width + 2
    columns = np.arange(width + 1, dtype=np.int16)
    # table[i + 1][:, j + 1] is the distance of the first i and j letters; row and column 0 are out of reach
    table = np.full((a.shape[1] + 2, n, step), a.shape[1] + width, dtype=np.int16)
    table[1, :, 1:] = columns
    flat = table.reshape(-1)
    base = (np.arange(n, dtype=np.int32) * step)[:, None]
    last_row = np.zeros((n, width), dtype=np.int32)
    last_column = np.zeros((n, width), dtype=np.int16)
    row = np.empty((n, width + 1), dtype=np.int16)
    for i in range(1, a.shape[1] + 1):
        match = b == a[:, i - 1 : i]
        np.maximum.accumulate(np.where(match, columns[1:], 0)[:, :-1], axis=1, out=last_column[:, 1:])
        above = table[i]
        value = np.minimum(above[:, 1:-1] + ~match, above[:, 2:] + 1)
        # letters swapped, maybe with others in between
        if i > 1:
            came = flat.take(last_row * (n * step) + base + last_column)
            np.minimum(value, came + (i - last_row + columns[:-1] - last_column).astype(np.int16), out=value)
        # insertions run along the row: a prefix minimum of value minus position
        row[:, 0] = i
        np.subtract(value, columns[1:], out=row[:, 1:])
        table[i + 1, :, 1:] = np.minimum.accumulate(row, axis=1) + columns
        last_row[match] = i
    return table[a_len + 1, np.arange(n), b_len + 1]


def letter_counts(strings: list[str]) -> np.ndarray:
    codes, lengths = encode(strings)
    inside = np.arange(codes.shape[1]) < lengths[:, None]
    cell = (codes & 31) * len(strings) + np.arange(len(strings))[:, None]
    return np.bincount(cell[inside], minlength=32 * len(strings)).reshape(32, len(strings)).astype(np.int16)


def close_pairs(left: list[str], right: list[str], radius: int, same: bool = False) -> list[tuple[str, str, int]]:
    """Pairs (x, y, distance) of different strings within the radius, x from left and y from right.

    If both are the ``same`` list each pair comes once. Letter counts bound the distance from
    below (surplus letters of either side) and leave few pairs for the full metric.
    """
    if not left or not right:
        return []
    a, b = letter_counts(left), letter_counts(right)
    gap = np.zeros((len(left), len(right)), dtype=np.int16)
    net = np.zeros_like(gap)
    for c in range(32):
        if a[c].any() or b[c].any():
            d = a[c][:, None] - b[c][None, :]
            net += d
            gap += np.abs(d)
    near = (gap + np.abs(net)) // 2 <= radius
    if same:
        near = np.triu(near, 1)
    (i, j), out = np.nonzero(near), []
    (ca, la), (cb, lb) = encode(left), encode(right)
    for at in range(0, len(i), 100_000):
        x, y = i[at : at + 100_000], j[at : at + 100_000]
        d = distances(ca[x], la[x], cb[y], lb[y])
        out += [(left[x[k]], right[y[k]], int(d[k])) for k in np.flatnonzero(d <= radius) if left[x[k]] != right[y[k]]]
    return out


def metric_join(strings: DataFrame, radius: int, cell: int = 512, fan_out: int = 64, shrink: int = 4, most_levels: int = 6) -> DataFrame:
    """All pairs ``(tag, a, b, distance)`` with a < b of one tag within Damerau-Levenshtein ``radius``.

    ``strings`` has ``(tag, s)``, distinct. Every pair is found: if x and y are within the radius,
    the pivot nearest to one is at most twice the radius farther from the other than that one's own
    nearest, and the one whose home is later is replicated to the earlier home. A cell of more than
    ``cell`` strings gets about one pivot for each ``cell`` of them, at most ``fan_out`` a level, and
    cells that are still large are partitioned again where a level left at most one in ``shrink``. What is left of any
    size is compared in chunks of strings of like length (bands one wider than the radius), each pair
    of chunks of one or neighbouring bands a row of its own, so no task meets a whole hot cell.
    """

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for cell_id, part in batch.groupby("cell", sort=False):
                names, strings = list(part["pivots"].iloc[0]), list(part["s"])
                (codes, lengths), (p, p_len) = encode(strings), encode(names)
                d = np.empty((len(strings), len(names)), dtype=np.int32)
                for k in range(len(names)):
                    d[:, k] = distances(p[k : k + 1], p_len[k : k + 1], codes, lengths)
                home = d.argmin(axis=1)
                inside = (d <= d.min(axis=1)[:, None] + 2 * radius) & (np.arange(len(names)) <= home[:, None])
                i, c = np.nonzero(inside)
                parts.append(
                    pd.DataFrame(
                        {"tag": part["tag"].to_numpy()[i], "cell": [f"{cell_id}.{x}" for x in c], "s": [strings[x] for x in i], "homes": part["homes"].to_numpy()[i] * 2 + (c == home[i]), "parent": part["n"].to_numpy()[i]}
                    )
                )
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["tag", "cell", "s", "homes", "parent"])

    # a bit of homes for each level, set where the string is at home; a pair is compared where one of the two is, at every level
    rows = strings.select("tag", F.col("tag").alias("cell"), "s", F.lit(1).cast("bigint").alias("homes"), F.lit(1 << 60).cast("bigint").alias("parent"))
    done = None
    for level in range(most_levels):
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        sized = cut_lineage(rows.join(merged(sizes), "cell"))
        split = (F.col("n") > cell) & (F.col("n") * shrink <= F.col("parent")) if level < most_levels - 1 else F.lit(False)
        small = sized.where(~split).select("tag", "cell", "s", "homes", F.lit((2 << level) - 1).cast("bigint").alias("all"))
        done = small if done is None else done.unionByName(small)
        large = sized.where(split)
        if level == most_levels - 1 or large.isEmpty():
            break
        k = F.least(F.ceil(F.col("n") / F.lit(cell)), F.lit(fan_out)).cast("int")
        pivots = (
            large.withColumn("k", k)
            .groupBy("cell", F.pmod(F.xxhash64("s", F.lit(level)), F.col("k")).alias("slot"))
            .agg(F.min_by("s", F.xxhash64("s", F.lit(level + 1))).alias("pivot"))
            .groupBy("cell")
            .agg(F.sort_array(F.collect_set("pivot")).alias("pivots"))  # at most fan_out
        )
        mine = large.select("tag", "cell", "s", "homes", "n").join(merged(pivots), "cell")
        rows = cut_lineage(mine.mapInPandas(to_cells, "tag string, cell string, s string, homes bigint, parent bigint"))
    sized = done.withColumn("band", F.floor(F.length("s") / (radius + 1)))
    keys = ["tag", "cell", "all", "homes", "band"]
    parts = sized.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(1024)).cast("int").alias("parts"))
    chunks = cut_lineage(
        sized.join(merged(parts), keys)
        .groupBy(*keys, F.pmod(F.xxhash64("s", F.lit(2)), F.col("parts")).alias("chunk"))
        .agg(F.collect_list("s").alias("strings"))
    )
    kind = F.struct("homes", "band", F.col("chunk").alias("i"))
    left = chunks.select("tag", "cell", "all", kind.alias("x"), F.col("strings").alias("mine"))
    right = chunks.select("cell", kind.alias("y"), F.col("strings").alias("other"))
    met = left.join(merged(right), "cell").where(
        (F.abs(F.col("x.band") - F.col("y.band")) <= 1) & (F.col("x") <= F.col("y")) & (F.col("x.homes").bitwiseOR(F.col("y.homes")) == F.col("all"))
    )
    met = met.select("tag", "mine", "other", (F.col("x") == F.col("y")).alias("same")).repartition(F.col("tag"), F.xxhash64("mine"), F.xxhash64("other"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (tag, x, y, d)
                for tag, mine, other, same in zip(batch["tag"], batch["mine"], batch["other"], batch["same"])
                for x, y, d in close_pairs(list(mine), list(other), radius, same)
            ]
            yield pd.DataFrame(rows, columns=["tag", "x", "y", "distance"])

    found = met.mapInPandas(compare, "tag string, x string, y string, distance int")
    return found.select("tag", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").distinct()


def spellings(records: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(field, name, kind, rest, core, number)`` of every distinct spelling that names something.

    Nulls, blanks and placeholders are no names. The parts are read once for each distinct spelling.
    """
    one = lambda field: records.select(F.lit(field).alias("field"), F.col(field).alias("name"))
    distinct = one("composer").union(one("title")).where("trim(name) <> ''").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for field, name in zip(batch["field"], batch["name"]):
                parts = read_composer(name, lexicon) if field == "composer" else read_title(name)
                if parts and parts[2]:
                    rows.append((field, name, *parts))
            yield pd.DataFrame(rows, columns=["field", "name", "kind", "rest", "core", "number"])

    return distinct.mapInPandas(read, "field string, name string, kind string, rest string, core string, number string")


def nickname_map(lexicon: Lexicon):
    pairs = [v for nick, full in sorted(lexicon.nicknames.items()) for v in (F.lit(nick), F.array(*[F.lit(g) for g in sorted(full)]))]
    return F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.array(F.lit("")))


def matching_given(x, y, lexicon: Lexicon):
    """Column: two given names are the same, one being maybe a nickname of the other.

    Names the lexicon doesn't know may differ by a letter or a swap, but two known ones not.
    """
    nick = nickname_map(lexicon)
    means = lambda c: F.coalesce(F.element_at(nick, c), F.array(c))
    known = lambda c: c.isin(*sorted(lexicon.given | set(lexicon.nicknames)))
    letters = lambda c: F.array_sort(F.split(c, ""))
    typo = (F.least(F.length(x), F.length(y)) > 3) & ((F.levenshtein(x, y) <= 1) | ((F.levenshtein(x, y) == 2) & (letters(x) == letters(y))))
    return (
        F.arrays_overlap(means(x), means(y)) | F.arrays_overlap(F.array(x), means(y)) | F.arrays_overlap(F.array(y), means(x))
        | (typo & ~(known(x) & known(y)))
    )


def starts_given(part, given, lexicon: Lexicon):
    """Column: the letters known of a given name begin it, or begin a name it is a nickname of."""
    nick = nickname_map(lexicon)
    return given.startswith(part) | F.coalesce(F.exists(F.element_at(nick, given), lambda g: g.startswith(part)), F.lit(False))


def entities(records: DataFrame, radius: int = 2, lexicon: DataFrame | None = None) -> DataFrame:
    """``(field, name, entity)`` for every spelling that names something.

    Cores are one if their distance is at most the radius and a third of the shorter's letters.
    Composers need agreeing given names; a spelling with a surname alone or with initials joins
    the one person it fits best, or none if several fit equally well. Titles need equal numbers and
    forms; one whose form can't be read joins the one work it fits best. ``lexicon`` is a small
    table ``(given, nickname)`` of given names; it helps where names stand surname first without a
    comma, where they are nicknames, and to tell a typo from another name.
    """
    known = Lexicon(None if lexicon is None else [(r["given"], r["nickname"]) for r in lexicon.select("given", "nickname").collect()])
    names = cut_lineage(spellings(records, known))
    keys = cut_lineage(
        names.select("kind", "rest", "core", "number").distinct().withColumn("key", F.concat_ws("\u0001", "kind", "rest", "core", "number"))
    )
    # tags of the metric space; a title of unread form may stand in each of its number's
    titles = keys.where("kind = 'title'")
    tag = F.when(F.col("kind") == "org", F.concat_ws("\u0001", F.lit("o"), "rest")).when(F.col("kind") == "title", F.concat_ws("\u0001", F.lit("t"), "rest", "number")).otherwise("p")
    unread = keys.where("kind = 'unread'").join(merged(titles.select(F.col("rest").alias("form"), "number").distinct()), "number")
    unread = unread.select(F.concat_ws("\u0001", F.lit("t"), "form", "number").alias("tag"), "core", "key", "kind", "rest")
    placed_in = cut_lineage(keys.where("kind <> 'unread'").select(tag.alias("tag"), "core", "key", "kind", "rest").unionByName(unread))
    near = metric_join(placed_in.select("tag", F.col("core").alias("s")).distinct(), radius)
    near = near.where(F.col("distance") * 3 <= F.least(F.length("a"), F.length("b")))
    same = placed_in.select("tag", F.col("core").alias("a"), F.col("core").alias("b"), F.lit(0).alias("distance")).distinct()
    near = cut_lineage(near.unionByName(near.select("tag", F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(same))
    side = lambda c: placed_in.select("tag", *[F.col(x).alias(f"{c}_{x}") for x in ("core", "key", "kind", "rest")])
    met = (
        near.join(merged(side("x").withColumnRenamed("x_core", "a")), ["tag", "a"])
        .join(merged(side("y").withColumnRenamed("y_core", "b")), ["tag", "b"])
        .where("x_key <> y_key")
        .select("x_key", "x_kind", "x_rest", "y_key", "y_kind", "y_rest", "distance")
        .distinct()
    )
    met = cut_lineage(met)
    whole = met.where(
        (F.col("x_kind") == F.col("y_kind"))
        & (
            F.col("x_kind").isin("title", "org")
            | ((F.col("x_kind") == "full") & matching_given(F.col("x_rest"), F.col("y_rest"), known))
        )
    ).select("x_key", "y_key")
    every = keys.where("kind not in ('part', 'unread')").select(F.col("key").alias("x_key"), F.col("key").alias("y_key"))
    full = cut_lineage(connected_components(whole.unionByName(every), "x_key", "y_key"))
    # initials, surnames alone and unread forms: the one entity at the least distance that fits
    of_person = (F.col("x_kind") == "part") & (F.col("y_kind") == "full") & starts_given(F.col("x_rest"), F.col("y_rest"), known)
    of_work = (F.col("x_kind") == "unread") & (F.col("y_kind") == "title")
    fits = (
        met.where(of_person | of_work)
        .join(merged(full.select(F.col("node").alias("y_key"), "component")), "y_key")
        .groupBy("x_key", "distance")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    )
    best = cut_lineage(fits.groupBy("x_key").agg(F.min_by(F.struct("lo", "hi"), "distance").alias("e")))
    placed = best.where("e.lo = e.hi").select(F.col("x_key").alias("node"), F.col("e.lo").alias("component"))
    alone = keys.where("kind in ('part', 'unread')").select(F.col("key").alias("node")).join(merged(best.select(F.col("x_key").alias("node"))), "node", "left_anti")
    alone = cut_lineage(alone)
    loose = met.where((F.col("x_kind") == "part") & (F.col("y_kind") == "part") & (F.col("x_rest") == F.col("y_rest")))
    loose = loose.join(merged(alone.withColumnRenamed("node", "x_key")), "x_key").join(merged(alone.withColumnRenamed("node", "y_key")), "y_key")
    rest = connected_components(
        loose.select("x_key", "y_key").unionByName(alone.select(F.col("node").alias("x_key"), F.col("node").alias("y_key"))), "x_key", "y_key"
    )
    unsure = best.where("e.lo <> e.hi").select(F.col("x_key").alias("node"), F.col("x_key").alias("component"))
    entity = full.unionByName(placed).unionByName(rest).unionByName(unsure)
    return (
        names.withColumn("key", F.concat_ws("\u0001", "kind", "rest", "core", "number"))
        .join(merged(entity.withColumnRenamed("node", "key")), "key")
        .select("field", "name", F.col("component").alias("entity"))
    )


def found(records: DataFrame, **options) -> DataFrame:
    """``(field, name_a, name_b)``: every pair of different spellings of one entity, smaller first."""
    linked = cut_lineage(entities(records, **options))
    a = linked.select("field", "entity", F.col("name").alias("name_a"))
    b = linked.select("field", "entity", F.col("name").alias("name_b"))
    return a.join(merged(b), ["field", "entity"]).where("name_a < name_b").select("field", "name_a", "name_b")


def variants(records: DataFrame, **options) -> DataFrame:
    """``(field, name, entity_name, n_spellings)``: each spelling with a name for its entity (its smallest spelling)."""
    linked = cut_lineage(entities(records, **options))
    groups = linked.groupBy("field", "entity").agg(F.min("name").alias("entity_name"), F.count(F.lit(1)).alias("n_spellings"))
    return linked.join(merged(groups), ["field", "entity"]).select("field", "name", "entity_name", "n_spellings")
