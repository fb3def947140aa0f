"""Scalar functions on labels, titles, paths and cells: built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell a composer, in order; the first group with a hit wins.
COMPOSERS = {
    "Bach": ["bach", "bwv", "j._s._bach", "js bach"],
    "Beethoven": ["beethoven", "moonlight", "pathetique", "fur_elise"],
    "Chopin": ["chopin", "nocturne", "ballade", "waltz", "prelude op", "opus_28"],
    "Debussy": ["debussy", "clair_de_lune", "arabesque"],
    "Mozart": ["mozart", "k._545", "k._331", "turkish march", "marche_turque"],
    "Schubert": ["schubert", "ave_maria", "serenade", "standchen"],
    "Satie": ["satie", "gymnopedie", "gnossienne"],
    "Joplin": ["joplin", "entertainer", "maple_leaf"],
    "Tchaikovsky": ["swan_lake", "sugar_plum", "flowers"],
    "Pachelbel": ["canon_in_d", "pachelbel"],
    "Liszt": ["liszt", "campanella", "liebestraum"],
    "Brahms": ["hungarian_dance", "hungarian_sonata"],
    "Traditional": ["happy_birthday", "greensleeves", "bella_ciao", "carol_of_the_bells", "twinkle"],
}
#: Period of each composer; others are of period unknown.
PERIODS = {
    "Bach": "baroque", "Beethoven": "classical-romantic", "Chopin": "romantic", "Debussy": "modern-impressionist",
    "Mozart": "classical", "Schubert": "classical-romantic", "Satie": "modern", "Joplin": "ragtime", "Tchaikovsky": "romantic",
    "Pachelbel": "baroque", "Liszt": "romantic", "Brahms": "romantic", "Traditional": "traditional", "Unknown": "unknown",
}
#: Words that tell a form, in order.
FORMS = {
    "sonata": ["sonata", "sonate"], "waltz": ["waltz", "walzer"], "nocturne": ["nocturne"], "prelude": ["prelude", "prelud", "prlude"],
    "dance": ["dance", "danse"], "minuet": ["minuet"], "canon": ["canon"], "rag": ["rag", "entertainer"],
    "song": ["serenade", "maria", "bells", "birthday"],
}
#: Words that tell an arrangement, in order.
ARRANGEMENTS = {
    "pedagogical_easy": ["easy", "beginner"], "annotated_fingering": ["fingered"],
    "arrangement": ["arrangement", "arrg", "solo_piano", "variation"],
}


def plain(text: Column) -> Column:
    """Lower case, hyphens and blanks as underscores."""
    return F.translate(F.lower(text), "- ", "__")


def first_match(text: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The first rule one of whose words the text contains."""
    out = None
    for name, words in rules.items():
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def composer(filename: Column, given: Column) -> Column:
    """The composer given, if not blank, else the one the file name tells, else Unknown."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), first_match(plain(filename), COMPOSERS, "Unknown"))


def form(title: Column) -> Column:
    return first_match(plain(title), FORMS, "piece")


def arrangement(title: Column) -> Column:
    return first_match(plain(title), ARRANGEMENTS, "standard")


def difficulty(title: Column, notes: Column, per_measure: Column) -> Column:
    easy = reduce(lambda a, b: a | b, [F.contains(plain(title), F.lit(w)) for w in ("easy", "beginner")])
    return (
        F.when(easy, "easy").when((notes >= 900) | (per_measure >= 7.5), "advanced").when((notes <= 120) & (per_measure <= 3.0), "easy")
        .when((notes >= 350) | (per_measure >= 4.5), "intermediate-advanced").otherwise("intermediate")
    )


def slug_title(slug: Column) -> Column:
    """A slug as a title: words parted by blanks, each with a capital."""
    return F.initcap(F.trim(F.regexp_replace(slug, "[_-]+", " ")))


def source_label(path: Column) -> Column:
    """A known source among the folders of a path, else the folder after ``external``, else unknown."""
    parts = F.split(F.lower(path), "/")
    out = None
    for name in ("musetrainer", "symbtr", "asap", "pdmx"):
        out = F.when(F.array_contains(parts, name), name) if out is None else out.when(F.array_contains(parts, name), name)
    after = F.array_position(parts, "external")
    return out.when((after > 0) & (after < F.size(parts)), F.get(parts, after.cast("int"))).otherwise("unknown")


def device_class(device: Column) -> Column:
    return F.when(F.lower(device).rlike("cuda|gpu|mps"), "gpu").otherwise("cpu")


def truth(text: Column) -> Column:
    """A boolean written as a word or digit; null if it is none."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("1", "true", "yes"), True).when(word.isin("0", "false", "no"), False)


def redacted_paths(text: Column) -> Column:
    """Absolute paths replaced by a mark; what follows a web scheme stays."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<![\w:/.])(?:/[\w.~-]+){2,}/?", "<path>"), r"\b[A-Za-z]:\\[^\s\"']+", "<path>")


def safe_relative(path: Column) -> Column:
    """Whether a path stays below its root: not absolute, no drive, no step up, nothing empty."""
    return (F.length(path) > 0) & ~path.rlike(r"^[/\\]|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|//")


def number_list(text: Column, kind: str = "int") -> Column:
    """A list typed with commas as numbers; blanks are dropped, anything else is null."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast(kind))


def top_items(items: Column, n: int) -> Column:
    """``name (share)`` of the first ``n`` structs (share, name), most first, as one string."""
    ordered = F.slice(F.sort_array(items, asc=False), 1, n)
    return F.array_join(F.transform(ordered, lambda x: F.concat(x["name"], F.lit(" ("), F.round(x["share"], 3).cast("string"), F.lit(")"))), ", ")
