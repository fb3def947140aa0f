"""Given names, nicknames and edit distance, shared by name linking and name finding."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

#: Given names with the nicknames in common use for them (accents folded).
GIVEN = {
    "alexander": "sasha alex", "anouk": "", "anselm": "", "asa": "", "augustine": "gus", "ayse": "",
    "bartholomew": "bart", "begona": "", "birgit": "", "charles": "chuck charlie", "concepcion": "concha",
    "dolores": "lola", "dorothea": "dora", "edward": "ned eddie", "eleanor": "nell", "elizabeth": "liz beth",
    "emmanuel": "manny", "francisco": "paco", "frederica": "freddie", "friedrich": "fritz", "gregor": "grisha",
    "guadalupe": "lupe", "harold": "harry", "henrietta": "etta", "ignacio": "nacho", "ines": "", "isidora": "dora",
    "joaquin": "", "johannes": "hannes", "josefina": "pepa", "jurgen": "", "katherine": "kate kathy", "kwame": "",
    "lavinia": "vinnie", "leopold": "poldi", "lucia": "", "margaret": "peggy maggie", "matteo": "",
    "maximilian": "max", "michael": "mike", "mirela": "", "nathaniel": "nat", "nikolai": "kolya", "noemie": "",
    "octavia": "tavi", "orla": "", "ottoline": "otty", "patricia": "pat", "pavel": "", "petra": "",
    "philippa": "pippa", "quentin": "quen", "ramona": "mona", "robert": "bob rob", "rosalind": "roz", "samuel": "sam",
    "sebastian": "bastian", "soledad": "", "teodora": "dora", "theodore": "ted theo", "tobias": "toby",
    "ursula": "ulla", "valentina": "tina", "victoria": "vicky", "wilhelmina": "mina", "william": "bill will",
    "yolanda": "yoli", "zacharias": "zach", "zoe": "",
}
#: Further given names common in English, German and Spanish, without those that are words or titles too.
COMMON = frozenset(
    "adam adrian alan albert alberto alejandro alfred alice amanda amelia ana andrea andreas andres andrew anke anna anne annette anthony antonio arthur "
    "barbara beatriz benjamin bernd bernhard brian bruno camila carlos carolina caroline catherine charlotte christian christine christoph christopher "
    "claudia clemens cristina daniel daniela david deborah diego dieter dietrich dominik donald dorothy edith eduardo elena elisabeth emily emma enrique "
    "erich erik ernst esther eugen eva fatima felipe fernando florian franz frederick gabriel gabriela georg george gerhard gertrud gisela gonzalo gustav hans "
    "hannah heinrich helen helga henry hermann hildegard hugo ingrid isabel isabella jacob jakob james jan janet jennifer jessica johann john jonas "
    "jonathan jorge jose joseph juan judith julia julian karen karin karl katharina kenneth klaus kurt laura lawrence leonard lorenzo louise ludwig luis lukas "
    "manfred manuel marcos margarita maria marie marta martha martin matthew matthias mercedes miguel monika nancy nicholas nicole olivia otto pablo patrick "
    "paul paula pedro peter philip rachel rafael rainer raymond rebecca renate ricardo richard roberto rodrigo ronald rudolf ruth sabine samantha sandra santiago "
    "sarah sergio simon sofia sophie stefan stephanie stephen steven susan susanne teresa theresa thomas timothy tomas ulrich vera veronica vicente vincent "
    "virginia walter werner wolfgang".split()
)
NICKNAMES: dict[str, frozenset[str]] = {}
for _given, _nicks in GIVEN.items():
    for _nick in _nicks.split():
        NICKNAMES[_nick] = NICKNAMES.get(_nick, frozenset()) | {_given}

#: Particles that belong to a surname.
PARTICLES = frozenset("von van der den de del la las los di da du ter zu zur".split())


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def edit_distance(a: str, b: str, limit: int | None = None) -> int:
    """Unrestricted Damerau-Levenshtein distance, a true metric; ``limit + 1`` stands for more.

    Insertions, deletions, substitutions and swaps of neighbours cost one, also where letters
    were put between swapped ones (the restricted form breaks the triangle inequality).
    """
    if a == b:
        return 0
    if limit is not None and abs(len(a) - len(b)) > limit:
        return limit + 1
    far = len(a) + len(b)
    last_row: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    d[1][1:] = range(len(b) + 1)
    for i in range(1, len(a) + 1):
        last_match, best = 0, far
        row, above, out = d[i], d[i], d[i + 1]
        out[1] = i
        for j in range(1, len(b) + 1):
            k, m = last_row.get(b[j - 1], 0), last_match
            if a[i - 1] == b[j - 1]:
                cost, last_match = 0, j
            else:
                cost = 1
            value = min(row[j] + cost, out[j] + 1, above[j + 1] + 1, d[k][m] + i - k - 1 + 1 + j - m - 1)
            out[j + 1] = value
            if value < best:
                best = value
        last_row[a[i - 1]] = i
        # a swap reaches back at most limit + 1 rows within the limit
        if limit is not None and best > 2 * limit + 1:
            return limit + 1
    found = d[len(a) + 1][len(b) + 1]
    return found if limit is None or found <= limit else limit + 1


def without_letters(word: str, most: int) -> set[str]:
    """The word and what is left of it after deleting up to ``most`` letters."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Fuzzy:
    """Looks words up allowing for typos.

    Words within distance k share what is left after at most k deletions each, so a look-up meets
    only words that share such a rest and checks these by the metric.
    """

    def __init__(self, words: Iterable[str], least: int = 4, long: int = 7, shortest: int = 4) -> None:
        """Words of fewer than ``least`` letters and tokens of fewer than ``shortest`` are matched as they stand only; words from ``long`` letters on within two edits."""
        self.words, self.least, self.long, self.shortest = frozenset(words), least, long, shortest
        self.rests: dict[str, set[str]] = {}
        for w in self.words:
            if len(w) >= least:
                for rest in without_letters(w, 2 if len(w) >= long else 1):
                    self.rests.setdefault(rest, set()).add(w)
        self.seen: dict[str, list[tuple[int, str]]] = {}

    def near(self, token: str) -> list[tuple[int, str]]:
        """``(distance, word)`` of the words a token may be a typo of, nearest first."""
        if token in self.words:
            return [(0, token)]
        if len(token) < self.shortest or len(token) > 64:
            return []
        if token not in self.seen:
            found = set().union(*(self.rests.get(r, ()) for r in without_letters(token, 2)))
            out = []
            for w in found:
                limit = 2 if len(w) >= self.long and len(token) > 4 else 1
                if (d := edit_distance(token, w, limit)) <= limit:
                    out.append((d, w))
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[token] = sorted(out)
        return self.seen[token]


class Lexicon:
    """Given names and nicknames; by default those above, else of a small table ``(given, nickname)``."""

    def __init__(self, rows: Iterable[tuple[str, str | None]] | None = None) -> None:
        pairs = [(g, n) for g, ns in GIVEN.items() for n in ns.split() or [None]] if rows is None else [(fold(g), n and fold(n)) for g, n in rows if g]
        self.given = frozenset(g for g, _ in pairs)
        self.nicknames: dict[str, frozenset[str]] = {}
        for g, n in pairs:
            if n:
                self.nicknames[n] = self.nicknames.get(n, frozenset()) | {g}
        self.fuzzy = Fuzzy(self.given), Fuzzy(self.nicknames)

    def known(self, token: str) -> str | None:
        """The given name (or nickname) a folded token spells, allowing for typos; None if none or unsure."""
        if token in self.given or token in self.nicknames:
            return token
        for fuzzy in self.fuzzy:  # a full name before a nickname
            near = [(d, w) for d, w in fuzzy.near(token) if d < 2 or len(token) > 5]
            if near:
                return near[0][1] if len(near) == 1 or near[1][0] > near[0][0] else None
        return None
