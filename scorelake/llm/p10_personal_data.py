"""Problem 10: personal information inside free text.

Spans are found by patterns for each kind (addresses before phones, so that a house number
is no phone) and by given names with the words around them. Numbers are read and validated
(check letters and digits, areas, calendar) and replaced by format-preserving pseudonyms: a
keyed Feistel network permutes the values of one format among themselves, valid ones among the
valid, so the layout stays, equal values stay linked across documents and the owner of the key
can undo it. Other items get a keyed tag. Each place becomes a typed placeholder.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.names import COMMON, GIVEN, NICKNAMES, PARTICLES, fold

KINDS = ("email", "id_number", "address", "phone", "person_name")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._+%-]*[A-Za-z0-9])?"
_DOT_WORD = r"(?: ?[\[({] ?(?:dot|punkt|punto) ?[\])}] ?| (?:dot|punkt|punto) )"
_DOT = rf"(?:\.|{_DOT_WORD})"
_AT_SIGN = r"(?: ?@ ?| ?[\[({] ?(?:at|arroba|@) ?[\])}] ?)"
EMAIL = re.compile(
    rf"(?<![\w.+-])(?:{_LOCAL}{_AT_SIGN}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}|"
    rf"{_LOCAL} (?:at|arroba|klammeraffe) {_LABEL}(?:{_DOT_WORD}{_LABEL})*{_DOT_WORD}[A-Za-z]{{2,}})(?![\w@])",
    re.I,
)

AT_SIGN = re.compile(rf"{_AT_SIGN}| (?:at|arroba|klammeraffe) ", re.I)

ID_NUMBER = re.compile(
    r"(?<![\w./-])(?:"
    r"[A-Z]{2}[ \u00a0]?\d{2}[ \u00a0]?\d{2}[ \u00a0]?\d{2}[ \u00a0]?[A-D]"  # two letters, six digits, a letter
    r"|\d{2}\.?\d{3}\.?\d{3} ?-? ?[A-Z]"  # eight digits and a check letter
    r"|[XYZ] ?-? ?\d{7} ?-? ?[A-Z]"  # foreigner's number
    r"|\d{3}([ \u00a0-])\d{2}\1\d{4}"  # three, two and four digits
    r"|9\d{8}"  # the same nine digits unparted
    r"|\d{2} \d{3} \d{3} \d{3}"  # eleven digits of a tax id
    r")(?![\w-]|\.\d)"
)
#: Nine or eleven unparted digits are an identity number after a word that says so.
BARE_NUMBER = re.compile(r"(?<![\w./-])(?:\d{9}|\d{11})(?![\w-]|\.\d)")
SAYS_IDENTITY = re.compile(
    r"\b(?:ssn|social security|tax|national|passport|identity|insurance|id|dni|nie|nif|steuer\w*|ausweis\w*|personalausweis)"
    r"(?:[ -](?:id|no|nr|number|nummer|n[úu]m(?:ero)?|code))?[.:]?[ \u00a0]{0,2}(?:is |ist |es )?$",
    re.I,
)

PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+\d{1,3}(?:[ \u00a0./-]?\(0\))?(?:[ \u00a0./-]?\(?\d{1,5}\)?){1,2}(?:[ \u00a0./-]?\d{2,8}){1,3}"
    r"|00\d{1,3}[ \u00a0./-]\(?0?\)?\d{1,5}(?:[ \u00a0./-]\d{2,8}){1,3}"
    r"|\(\d{2,5}\)[ \u00a0]?\d{3,5}[ \u00a0.-]?\d{3,5}"
    r"|\d{3}([.-])\d{3}\1\d{4}"
    r"|0\d{2,4}[ \u00a0/-]\d{3,8}(?:[ \u00a0-]\d{3,4})?"
    r")(?![\w/-]|\.\d)"
)
#: Digits in a whole number by country code; a longer match swallowed what follows.
COUNTRY_DIGITS = {"1": 11, "44": 12, "49": 13, "34": 11, "33": 11, "39": 12, "41": 11, "43": 13, "351": 12, "52": 12, "54": 13}
MOST_DIGITS = 15  # of any country

_WORD = r"[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[A-ZÀ-ÖØ-Þ]?[\w'’]+)*"
_POSTCODE = r"[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}"
#: Further words of four letters or more belong to a place, but only if the address ends after them.
_PLACE = (
    rf"(?:{_WORD}(?:(?:[ -](?:upon|on|am|an der|ob der|de|del|de la|de los))?[ -](?=\w{{4}}){_WORD}){{1,3}}(?=,? {_POSTCODE}|[,;.)\]\r\n]|$)|{_WORD})"
)
_ROAD = (
    r"(?:Street|St\.?|Avenue|Ave\.?|Court|Ct\.?|Lane|Ln\.?|Road|Rd\.?|Square|Sq\.?|Terrace|Drive|Dr\.|Close|Row|Hill|Way|Gardens|"
    r"Crescent|Walk|Mews|Green|Boulevard|Blvd\.?|Parade|Grove|Quay)"
)
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite|Room|No)\.? ?\d+[A-Za-z]?"
_SEP = r"(?:, ?\n?|\n)"
ADDRESS = re.compile(
    r"(?<![\w/])(?:"
    rf"(?:{_UNIT},? )?\d+[A-Za-z]?(?:-\d+)?,? {_WORD}(?: {_WORD})? {_ROAD}(?!\w)(?:, {_UNIT}(?!\w))?(?:,? ?\n?{_PLACE}(?= {_POSTCODE})|, {_PLACE})?(?:,? {_POSTCODE}(?!\w))?"
    rf"|(?:P\. ?O\. ?|PO |Post Office )Box \d+(?:, {_PLACE})?(?:,? {_POSTCODE}(?!\w))?"
    rf"|(?:Apartado(?: de Correos)?|Apdo\.?|Postfach) \d+(?:,(?: \d{{5}})? {_PLACE})?"
    rf"|(?:C/|C\.|Calle|Avda\.?|Av\.|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Travesía) ?(?:(?:del?|la|el|los|las) )*{_WORD}(?: (?:(?:del?|la) )*{_WORD})?"
    rf",? (?:n[º°.] ?)?(?:\d+[A-Za-z]?|s/n)(?!\w)(?:, \d+ ?[ºª°](?: ?[A-Z](?!\w))?)?(?:,(?: \d{{5}})? {_PLACE})?"
    rf"|(?:(?:Am|An der|Im|In der|Auf der|Zum|Zur) {_WORD} \d+ ?[a-z]?(?!\w), \d{{5}} {_PLACE})"
    rf"|[A-ZÄÖÜ][\w-]*?(?:str\.|stra(?:ß|ss)e|weg|platz|allee|gasse|ring|damm|ufer) \d+ ?[a-z]?(?!\w)(?:,(?: \d{{5}})? {_PLACE})?"
    r")"
)

#: Words that start a sentence after a letter with a stop, and are no surnames.
NO_SURNAME = frozenset(
    fold(word)
    for word in (
        "the this that these those there it in on at as a an and both but by bar bars box call clef coda compare contact corrections "
        "duration fingering for from he her his i if is keep letter lists mail measure midi my nobody note nothing now of once one op or our page "
        "play please ps rehearsal rehearsals reply return second see send she shelf sheet short so some tel text thanks they to token "
        "transcribed version we what when who why with write you your auf aus ab am an bei bis bitte damit dank dauer das der die diese dort "
        "ein eine er es für gilt hinweis ich im ist kurz man nach niemand nr op sie signatur takt und unter von vor wir zu zum übertragen "
        "waltz sonata nocturne ballad march minuet prelude rondo fantasia serenade hymn suite variations walzer vals marcha sonate lied etude polka "
        "a al como con conviene compárese compases cuando de del desde dónde duración el ella ella en ensayamos envíe es escriba esta este "
        "gracias la las llame lo los mi más nadie no nota op para pero por pregunte pues que se según si sin su tras transcripción un una "
        "vale véase y zona major minor dur moll"
    ).split()
)
#: Short names that are words too; in lower case they name nobody by themselves.
ALSO_WORDS = frozenset("will rob max pat mina bill bart".split())
BEFORE = re.compile(r"(?:(?:\b(?:with|by|of|for|to|and|ask|profesora|profesor|Frau|Herrn?|Bitte|payee|und|von|an|a|de|y)|Dr\.|:|\(c\)|[>.!?*\])-]) ?|[\n\r\t]|^)$")
#: Words whose own preposition stands before a name.
OF = re.compile(r"\b(?:Transcripción|transcripción|Übertragen|übertragen|Arreglo|arreglo|Copia|copia|Bearbeitung|Kopie|Edición|edición) $")
_GIVENS = frozenset(GIVEN) | frozenset(NICKNAMES) | COMMON
_LETTER = r"[^\W\d_]"
_SURNAME = rf"{_LETTER}(?:{_LETTER}|['’](?={_LETTER}))*(?:-{_LETTER}(?:{_LETTER}|['’](?={_LETTER}))*)*"
_PARTS = "(?:(?:" + "|".join(sorted(PARTICLES, key=len, reverse=True)) + ") )*"
_GIVEN = "(?:" + "|".join(sorted(_GIVENS, key=len, reverse=True)) + ")"
#: Run on folded lower-case text; the case is looked at in the text itself.
NAME = re.compile(
    rf"(?<![\w@.+'’-])(?:"
    rf"(?P<given>{_GIVEN})(?P<middle>(?: (?:{_GIVEN}|{_LETTER}\.(?: ?{_LETTER}\.)*))*) (?P<last>{_PARTS}{_SURNAME})"
    rf"|(?P<rlast>{_PARTS}{_SURNAME}), (?P<rgiven>{_GIVEN})(?P<rmiddle>(?: {_LETTER}\.)*)"
    rf"|(?P<initials>{_LETTER}\.(?: ?{_LETTER}\.)*) (?P<ilast>{_PARTS}{_SURNAME})"
    rf"|(?P<jlast>{_PARTS}{_SURNAME}), (?P<jinitials>{_LETTER}\.(?: ?{_LETTER}\.)*)"
    rf")(?![\w@])"
)
#: Forms of address; a person is named after them, whatever the given name.
ADDRESSED = re.compile(
    r"(?:\b(?:Dr|Mr|Mrs|Ms|Prof|Rev|Sr|Sra|Srta)\. |\b(?:Miss|Sir|Dame|Frau|Herrn?|Se[ñn]ora?|Do[ñn]a|Don|Madame|Monsieur|Maestr[oa]|profesora?|Professor(?:in)?) )"
    rf"(?P<name>{_WORD} (?:{_WORD} |[A-Z]\. ?)*(?:(?:von|van|der|de|la|del|di|da|du|zu) )*{_WORD}(?: {_WORD})?)"
)
_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


class _Folding(dict):
    """One plain lower-case character for each, so positions stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = c.lower() if c < "\x80" else unicodedata.normalize("NFD", c)[0].lower()
        self[code] = base if len(base) == 1 else c
        return self[code]


_FOLDING = _Folding()


def folded(text: str) -> str:
    """Lower case without accents, of the same length."""
    return text.translate(_FOLDING)


def _shape(word: str) -> str:
    letters = [c for c in word if c.isalpha()]
    if all(c.islower() for c in letters):
        return "lower"
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return "upper"
    return "title" if letters and letters[0].isupper() else "mixed"


def _named(text: str, low: str, m: re.Match) -> tuple[int, int] | None:
    """The span of a name match, or None if its case or words speak against a name."""
    if m.group("given"):
        given, last = text[m.start("given") : m.end("given")], text[m.start("last") : m.end("last")]
        low_given, low_last = m.group("given"), m.group("last")
    elif m.group("rgiven"):
        given, last = text[m.start("rgiven") : m.end("rgiven")], text[m.start("rlast") : m.end("rlast")]
        low_given, low_last = m.group("rgiven"), m.group("rlast")
    else:
        g = "initials" if m.group("initials") else "jinitials"
        l = "ilast" if m.group("initials") else "jlast"
        given, last = text[m.start(g) : m.end(g)], text[m.start(l) : m.end(l)]
        low_given, low_last = "", m.group(l)
    core = last.split(" ")[-1]
    low_core = low_last.split(" ")[-1]
    if len(core) < 3 or low_core in NO_SURNAME or low_core in _GIVENS and not low_given:
        return None
    shape = _shape(core)
    if not low_given:
        # initials are capitals, and a surname is written like one
        if not given.replace(" ", "").replace(".", "").isupper() or shape not in ("title", "upper") or len(core) < 4:
            return None
        return m.start(), m.end()
    have = _shape(given)
    if have == "lower":
        if shape != "lower":
            return None
        cued = re.match(r" ?[<(;,\n]|$", text[m.end() : m.end() + 2]) or (
            low_given != "will" and BEFORE.search(text, max(0, m.start() - 12), m.start())
        )
        if low_given in ALSO_WORDS and not cued:
            return None
    elif shape not in ("title", "upper"):
        return None
    return m.start(), m.end()


def name_starts(low: str) -> list[int]:
    """Where a name may begin: at a given name or initial, or at the surname in front of ", given"."""
    starts: set[int] = set()
    words: list[tuple[int, int, str]] = []
    for m in _NAME_WORD.finditer(low):
        begin, stop, word = m.start(), m.end(), m.group()
        if word in _GIVENS or (stop - begin == 1 and low[stop : stop + 1] == "."):
            starts.add(begin)
            if words and words[-1][1] == begin - 2 and low[begin - 2 : begin] == ", ":
                k = len(words) - 1
                starts.add(words[k][0])
                while k and words[k - 1][2] in PARTICLES and words[k - 1][1] == words[k][0] - 1 and low[words[k][0] - 1] == " ":
                    k -= 1
                    starts.add(words[k][0])
        words.append((begin, stop, word))
    return sorted(starts)


def names(text: str) -> list[tuple[int, int]]:
    low = folded(text)
    out, at = [], 0
    for start in name_starts(low):
        m = NAME.match(low, start) if start >= at else None
        span = _named(text, low, m) if m else None
        if span is None:
            continue
        if m.group("rgiven"):
            # "Place, Given Surname": the given name belongs to what follows
            follow = NAME.match(low, m.start("rgiven"))
            if follow and follow.group("given") and (inner := _named(text, low, follow)) and _shape(text[slice(*m.span("rgiven"))]) == _shape(text[follow.start("last") : follow.end("last")].split(" ")[-1]):
                span = inner
        # "Transcripción de Surname, Given": the preposition is no part of the name
        if (m.group("rgiven") or m.group("jinitials")) and span[0] == m.start() and OF.search(text, max(0, span[0] - 20), span[0]):
            words = low[span[0] : span[1]].split(" ")
            if words[0] in PARTICLES:
                span = span[0] + len(words[0]) + 1, span[1]
        out.append(span)
        at = span[1]
    taken = out[:]
    for m in ADDRESSED.finditer(text):
        s, e = m.span("name")
        words = {folded(w.strip(".,")) for w in text[s:e].split()}
        if not any(s < b and a < e for a, b in taken) and not words & NO_SURNAME:
            out.append((s, e))
    return sorted(out)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses, looked for around their signs only."""
    end = 0
    for sign in AT_SIGN.finditer(text):
        start = sign.start()
        while start > end and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
            start -= 1
        while start < sign.start() and text[start] == "%":
            start += 1
        m = EMAIL.match(text, start) if start < sign.start() else None
        if m:
            yield m.span()
            end = m.end()


def phone_end(text: str) -> int:
    """Length of the match that a number of its country can have."""
    plain = re.sub(r"^(?:\+|00)", "", text)
    if len(plain) == len(text):
        return len(text)
    code = next((plain[:n] for n in (3, 2) if plain[:n] in COUNTRY_DIGITS), "1" if plain.startswith("1") else "")
    most, seen = COUNTRY_DIGITS.get(code, MOST_DIGITS), 0
    for i in range(len(text) - len(plain) if text.startswith("00") else 0, len(text)):
        if text[i : i + 3] == "(0)":
            seen -= 1
        if text[i].isdigit():
            seen += 1
            if seen > most:
                return len(text[:i].rstrip(" \u00a0./-("))
    return len(text)


def find(text: str, dates: bool = False) -> list[tuple[str, int, int]]:
    """Disjoint ``(kind, start, stop)`` of one text; where kinds meet, the earlier kind of KINDS has it.

    Dates are only looked for if asked, after all other kinds.
    """
    spans: list[tuple[str, int, int]] = []

    def add(kind: str, start: int, stop: int) -> None:
        if not any(start < b and a < stop for _, a, b in spans):
            spans.append((kind, start, stop))

    for start, stop in emails(text):
        add("email", start, stop)
    for m in ID_NUMBER.finditer(text):
        add("id_number", *m.span())
    for m in BARE_NUMBER.finditer(text):
        if SAYS_IDENTITY.search(text, max(0, m.start() - 48), m.start()):
            add("id_number", *m.span())
    for m in ADDRESS.finditer(text):
        add("address", *m.span())
    for m in PHONE.finditer(text):
        found = m.group()
        stop = m.start() + phone_end(found)
        if sum(c.isdigit() for c in text[m.start() : stop]) >= 7:
            add("phone", m.start(), stop)
    for start, stop in names(text):
        add("person_name", start, stop)
    if dates:
        for m in DATE.finditer(text):
            if day_number(m.group()) is not None:
                add("date", *m.span())
    return sorted(spans, key=lambda s: s[1])


DATE = re.compile(r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)")


def _round(key: bytes, width: int, i: int, half: str) -> int:
    digest = hmac.new(key, f"{width}|{i}|{half}".encode(), hashlib.sha256).digest()
    return int.from_bytes(digest[:16], "big")


def permute_digits(digits: str, key: bytes, undo: bool = False) -> str:
    """A keyed permutation of the digit strings of one length (Feistel network, ten rounds)."""
    n = len(digits)
    if n < 2:
        shift = _round(key, n, 0, "") % 10
        return "".join(str((int(c) + (-shift if undo else shift)) % 10) for c in digits)
    u = n // 2
    left, right = digits[:u], digits[u:]
    for i in reversed(range(10)) if undo else range(10):
        if undo:
            value = (int(right) - _round(key, n, i, left)) % 10 ** len(right)
            left, right = f"{value:0{len(right)}d}", left
        else:
            value = (int(left) + _round(key, n, i, right)) % 10 ** len(left)
            left, right = right, f"{value:0{len(left)}d}"
    return left + right


def permute_below(x: int, size: int, key: bytes, undo: bool = False, like: Callable[[int], object] = lambda x: None) -> int:
    """A keyed permutation of [0, size) that keeps the class ``like`` of a value, by cycle walking."""
    width, mine = len(str(size - 1)), like(x)
    while True:
        x = int(permute_digits(f"{x:0{width}d}", key, undo))
        if x < size and like(x) == mine:
            return x


def permute_number(value: str, key: bytes, undo: bool = False) -> str:
    """Digits permuted, everything else in place; a country code and a trunk zero stay."""
    keep = re.match(r"\+\d{1,3}|00\d{2}|0", value)
    at = keep.end() if keep and len(value) > keep.end() + 4 else 0
    digits = "".join(c for c in value[at:] if c.isdigit())
    fresh = permute_digits(digits, key, undo) if digits else ""
    return value[:at] + laid_out(value[at:], fresh)


def laid_out(value: str, fresh: str) -> str:
    """``value`` with its digits replaced in order."""
    left = iter(fresh)
    return "".join(next(left) if c.isdigit() else c for c in value)


#: Check letters of Spanish identity numbers, by remainder of 23.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def check_digit(digits: str) -> int:
    """Check digit of ten digits by the hybrid system modulo 11 and 10."""
    product = 10
    for c in digits:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10


def social_class(x: int) -> bool:
    """Whether nine digits can be a social security number: no area 000, 666 or from 900, no group 00, no serial 0000."""
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def read_identity(value: str) -> tuple[str, bool | None]:
    """``(format, valid)`` of an identity number; None where a format has nothing to check."""
    plain = re.sub(r"[\W_]", "", value).upper()
    if re.fullmatch(r"\d{8}[A-Z]|[XYZ]\d{7}[A-Z]", plain):
        number = plain[:-1].translate(str.maketrans("XYZ", "012"))
        return ("foreigner" if plain[0] in "XYZ" else "national"), CHECK_LETTERS[int(number) % 23] == plain[-1]
    if re.fullmatch(r"\d{11}", plain):
        return "tax", plain[0] != "0" and check_digit(plain[:10]) == int(plain[10])
    if re.fullmatch(r"\d{9}", plain):
        return "social", social_class(int(plain))
    return "other", None


def permute_identity(value: str, key: bytes, undo: bool = False) -> str:
    """An identity number permuted within its format, valid ones among the valid and others among the others."""
    kind, _ = read_identity(value)
    if kind == "other":
        digits = "".join(c for c in value if c.isdigit())
        return laid_out(value, permute_digits(digits, key, undo) if digits else "")
    if kind == "social":
        digits = "".join(c for c in value if c.isdigit())
        return laid_out(value, f"{permute_below(int(digits), 10**9, key, undo, social_class):09d}")
    if kind == "tax":
        digits = "".join(c for c in value if c.isdigit())
        slip = (int(digits[10]) - check_digit(digits[:10])) % 10  # 0 if valid
        fresh = f"{permute_below(int(digits[:10]), 10**10, key, undo, lambda x: x < 10**9):010d}"
        return laid_out(value, fresh + str((check_digit(fresh) + slip) % 10))
    # a check letter: moved by as much as it was off, so only valid numbers give valid ones
    places = [i for i, c in enumerate(value) if c.isalnum()]
    plain = "".join(value[i] for i in places).upper()
    number = int(plain[:-1].translate(str.maketrans("XYZ", "012")))
    known = plain[-1] in CHECK_LETTERS
    slip = (CHECK_LETTERS.index(plain[-1]) - number) % 23 if known else 0
    fresh = permute_below(number, 3 * 10**7 if kind == "foreigner" else 10**8, key, undo)
    body = "XYZ"[fresh // 10**7] + f"{fresh % 10**7:07d}" if kind == "foreigner" else f"{fresh:08d}"
    letters = body + (CHECK_LETTERS[(fresh + slip) % 23] if known else plain[-1])
    out = list(value)
    for i, c in zip(places, letters):
        out[i] = c
    return "".join(out)


FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def day_number(value: str) -> int | None:
    """Days since 1900 of a date written as 1984-02-29 or 29.02.1984; None if there is no such day up to 2099."""
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})|(\d{2})\.(\d{2})\.(\d{4})", value)
    if not m:
        return None
    y, mo, d = (m.group(1), m.group(2), m.group(3)) if m.group(1) else (m.group(6), m.group(5), m.group(4))
    try:
        x = date(int(y), int(mo), int(d)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return x if 0 <= x < DAYS else None


def permute_date(value: str, key: bytes, undo: bool = False) -> str:
    """A date of 1900-2099 permuted among such dates, its layout kept; anything else as it stands."""
    x = day_number(value)
    if x is None:
        return value
    day = date.fromordinal(permute_below(x, DAYS, key, undo) + FIRST_DAY)
    return day.strftime("%Y-%m-%d" if value[4] == "-" else "%d.%m.%Y")


def placeholder(kind: str, value: str, key: bytes) -> tuple[str, bool | None]:
    """The typed placeholder of a value, and whether the value is valid in its format (None: nothing to check)."""
    if kind == "id_number":
        plain = re.sub(r"[^\dA-Za-z]", "", value).upper()
        return f"<ID_NUMBER {permute_identity(plain, key)}>", read_identity(plain)[1]
    if kind == "phone":
        digits = sum(c.isdigit() for c in value)
        return f"<PHONE {permute_number(value, key)}>", 7 <= digits <= MOST_DIGITS + 2
    if kind == "date":
        return f"<DATE {permute_date(value, key)}>", True
    same = " ".join(folded(value).split())
    return f"<{kind.upper()} {hmac.new(key, same.encode(), hashlib.sha256).hexdigest()[:8]}>", None


def replaced(text: str, key: bytes, dates: bool = False) -> list[tuple[str, int, int, str, bool | None]]:
    """``(kind, start, stop, placeholder, valid)`` of every place of one text."""
    return [(kind, start, stop, *placeholder(kind, text[start:stop], key)) for kind, start, stop in find(text, dates)]


def redact(text: str, key: bytes, dates: bool = False) -> str:
    """The text with a typed placeholder in every place; everything else as it stands."""
    return _put(text, replaced(text, key, dates))


def _put(text: str, places: list[tuple[str, int, int, str, bool | None]]) -> str:
    out, at = [], 0
    for _, start, stop, instead, _ in places:
        out += [text[at:start], instead]
        at = stop
    return "".join(out) + text[at:]


def places(documents: DataFrame, key: str, dates: bool = False) -> DataFrame:
    """``(doc_id, kind, start_char, stop_char, placeholder, valid)`` of every place, each with its pseudonym.

    Characters are code points from 0. Null and empty texts hold nothing. Whole texts are read,
    whatever their length. ``key`` is the secret of the pseudonyms; with the same key equal values
    stay linked. ``valid`` tells if a number is valid in its format, null where there is nothing to check.
    A document delivered twice is read once.
    """
    secret = key.encode()
    if not secret:
        raise ValueError("a key is needed")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, *place) for doc, text in zip(batch["doc_id"], batch["text"]) for place in replaced(text, secret, dates)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_char", "stop_char", "placeholder", "valid"])

    texts = documents.where("doc_id is not null and text <> ''").select("doc_id", "text")
    return texts.mapInPandas(scan, "doc_id bigint, kind string, start_char int, stop_char int, placeholder string, valid boolean")


def found(documents: DataFrame, key: str) -> DataFrame:
    """``(doc_id, kind, start_char, stop_char)`` of every place that :func:`places` replaces."""
    once = documents.select("doc_id", "text").where("doc_id is not null and text <> ''").dropDuplicates(["doc_id", "text"])
    return places(once, key).select("doc_id", "kind", "start_char", "stop_char")


def redacted(documents: DataFrame, key: str, dates: bool = False) -> DataFrame:
    """``(doc_id, text, n_places)``: every document; a null text stays null.

    ``key`` is the secret of the pseudonyms; with the same key equal values stay linked. With
    ``dates`` calendar dates are replaced too.
    """
    secret = key.encode()
    if not secret:
        raise ValueError("a key is needed")

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [None if t is None else replaced(t, secret, dates) for t in batch["text"]]
            text = [None if t is None else _put(t, m) for t, m in zip(batch["text"], made)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": text, "n_places": [len(m or ()) for m in made]})

    return documents.select("doc_id", "text").mapInPandas(clean, "doc_id bigint, text string, n_places int")
