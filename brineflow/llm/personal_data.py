"""Personal information inside free text: found, located in the source characters, replaced by typed placeholders.

A transducer rewrites a text into a plain form and keeps for each of its characters the source characters it stands
for: look-alike letters of other scripts, full-width forms, HTML entities, blanks of any kind, spelled-out digit runs,
and disguised at and dot signs. Detectors of mail addresses, identity numbers, telephone numbers, street addresses and
names run on the plain form, in this order, and a later one never takes characters of an earlier one; spans are then
mapped back. Names are found by a lexicon of given names and surnames that one pass over all texts learns from the
places where a person is introduced. Names introduced in a text count for that text; those introduced in at least
MIN_NAME_ROWS texts count for all texts, however many such names there are.

Defined results: null, empty and blank texts hold no mention; spans count characters (code points) from 0; repeats
all count; spans of one text do not overlap. Every detector is linear in the length of the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import ChainMap, Counter
from collections.abc import Callable, Collection, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.operators.joins import heavy_light_join
from brineflow.runtime.session import bounded_rows, ship_code, spread, written

KINDS = ("email", "id_number", "phone", "address", "name")
#: The lexicon is broadcast up to this number of names; beyond it each text gets its own names by a join.
MAX_NAMES = 200_000
#: Names introduced in at least this many texts count for all texts, others for the texts that introduce them.
MIN_NAME_ROWS = 2

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijsdhlABEKMHOPCTXIJSABEZHIKMNOPTYXo"))
#: Entities that occur in plain text.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&nbsp;": " ", "&#64;": "@", "&#46;": ".", "&commat;": "@", "&period;": "."}
#: Spelled digits.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}

_SPELLED = "|".join(DIGITS)
#: Parts of the transducer with what must stand in a text, in lower case, for each to be tried. None starts with a blank, so a scan is quick; blanks before a sign are taken with it.
_PARTS = (
    ("entity", "|".join(map(re.escape, ENTITIES)), ("&",)),
    ("at", r"[(\[{<]\s*(?i:at|arroba)\s*[)\]}>]\s*", ("at", "arroba")),
    ("dot", r"[(\[{<]\s*(?i:dot|punkt|punto|point)\s*[)\]}>]\s*", ("dot", "punkt", "punto", "point")),
    ("spoken", r"(?<=\s)(?i:at)\s+[\w-]+(?:\s+(?i:dot)\s+[\w-]+)+", ("dot",)),
    ("word_dot", r"(?<=\s)(?i:dot)\s+(?=\w)", ("dot",)),
    ("digits", rf"\b(?i:{_SPELLED})(?:[ -](?i:{_SPELLED})){{4,}}\b", ()),
    ("char", r"[^\x00-\x7fÀ-ɏ]", ()),
    ("blank", r"[\x85\xa0]", ()),
)
_OPENED = re.compile(r"[(\[{<]\s*(?:at|arroba|dot|punkt|punto|point)\s*[)\]}>]")
_SPOKEN_WORD = re.compile(r"(\s*(?i:at)\s+)|(\s+(?i:dot)\s+)|([\w-]+)")
_FOREIGN = re.compile(r"[^\x00-\x7fÀ-ɏ]")
_DIGIT_WORDS = tuple(w for w in DIGITS if w != "oh")


@lru_cache(maxsize=None)
def _transducer(parts: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{name}>{form})" for name, form, _ in _PARTS if name in parts))


def _needed(source: str, low: str) -> tuple[str, ...]:
    """The parts of the transducer that may find something."""
    opened = any(c in source for c in "([{<") and _OPENED.search(low)
    out = [name for name, _, words in _PARTS[:5] if any(w in low for w in words) and (opened or name not in ("at", "dot"))]
    if sum(w in low for w in _DIGIT_WORDS) > 1:
        out.append("digits")
    if not source.isascii():
        if _FOREIGN.search(source):
            out.append("char")
        if "\xa0" in source or "\x85" in source:
            out.append("blank")
    return tuple(out)


def _any(words: tuple[str, ...], low: str) -> bool:
    return any(w in low for w in words)


class Plain:
    """A rewritten text with the source range of each of its characters, kept as pieces that are shifted together."""

    __slots__ = ("text", "places", "pieces", "spelled")

    def __init__(self, source: str):
        self.spelled: list[tuple[int, int]] = []
        self.text, self.pieces = source, None
        parts = _needed(source, source.lower())
        if not parts:
            return
        out: list[str] = []
        places: list[int] = []  # where each piece starts in the plain form
        pieces: list[tuple[int, int, bool]] = []  # its source range, and whether characters correspond one by one
        length = 0

        def put(text: str, a: int, b: int) -> None:
            nonlocal length
            if text:
                same = len(text) == b - a
                if same and pieces and pieces[-1][2] and pieces[-1][1] == a:
                    pieces[-1] = (pieces[-1][0], b, True)
                else:
                    places.append(length)
                    pieces.append((a, b, same))
                out.append(text)
                length += len(text)

        place = 0
        for m in _transducer(parts).finditer(source):
            a, b, kind = m.start(), m.end(), m.lastgroup
            if kind in ("at", "dot", "word_dot", "spoken"):
                while a > place and source[a - 1].isspace():
                    a -= 1
                if kind in ("word_dot", "spoken") and not (a and (source[a - 1].isalnum() or source[a - 1] == "_")):
                    continue  # no word before it
            put(source[place:a], place, a)
            found = source[a:b]
            if kind == "entity":
                put(ENTITIES[found], a, b)
            elif kind == "at":
                put("@", a, b)
            elif kind in ("dot", "word_dot"):
                put(".", a, b)
            elif kind == "spoken":
                for w in _SPOKEN_WORD.finditer(found):
                    put(w[3] or ("@" if w[1] else "."), a + w.start(), a + w.end())
            elif kind == "digits":
                first = length
                for w in re.finditer(r"[^\W\d_]+", found):
                    put(DIGITS[w.group().lower()], a + w.start(), a + w.end())
                self.spelled.append((first, length))
            elif kind == "blank":
                put(" ", a, b)
            else:
                plain = LOOKALIKES.get(found) or unicodedata.normalize("NFKC", found)
                put(plain if len(plain) == 1 else " " if found.isspace() else found, a, b)
            place = b
        if pieces or place:
            put(source[place:], place, len(source))
            self.text, self.places, self.pieces = "".join(out), places, pieces

    @property
    def starts(self) -> list[int] | None:
        """Where the source of each character starts, None if the text was not rewritten."""
        return None if self.pieces is None else [self.source_span(i, i + 1)[0] for i in range(len(self.text))]

    @property
    def ends(self) -> list[int] | None:
        return None if self.pieces is None else [self.source_span(i, i + 1)[1] for i in range(len(self.text))]

    def source_span(self, a: int, b: int) -> tuple[int, int]:
        if self.pieces is None:
            return a, b
        i, j = bisect_right(self.places, a) - 1, bisect_right(self.places, b - 1) - 1
        (x, _, same), (y, z, alike) = self.pieces[i], self.pieces[j]
        return x + (a - self.places[i] if same else 0), y + b - self.places[j] if alike else z


_LOCAL = re.compile(r"[\w.%+'-]{0,63}\w\s?$")
_HOST = re.compile(r"\s?[\w-]{1,63}(?:\.[\w-]{1,63}){0,6}\.[^\W\d_]{2,24}(?![\w@])")


def _emails(text: str) -> list[tuple[int, int]]:
    """Spans around each at sign with a local part before it and a host behind it."""
    found, place = [], text.find("@")
    end = 0
    while place >= 0:
        low = max(end, place - 66)
        if (host := _HOST.match(text, place + 1)) and (local := _LOCAL.search(text[low:place])):
            end = host.end()
            found.append((low + local.start(), end))
        place = text.find("@", max(place + 1, end))
    return found


#: What identity numbers are called.
_ID_LABEL = (
    r"(?:passport|reisepass|pasaporte|passeport|DNI|NIE|NIF|NIR|SSN|social\ssecurity|(?:num[ée]ro\sde\s)?s[ée]curit[ée]\ssociale|seguridad\ssocial|"
    r"NI|national\sinsurance|steuer-?\s?id|steuernummer|steueridentifikationsnummer|(?:national\s)?id(?:entity)?\scard|(?:personal)?ausweis(?:nummer)?|"
    r"carte\sd['’]identit[ée]|documento\sde\sidentidad|tax\s(?:id|number))"
)
_ID = re.compile(
    rf"(?i:\b{_ID_LABEL}(?:\s?(?:number|no|nr|num|núm|n[°º]|numéro|número))?\.?\s?[:#]?\s?)(?-i:(?P<v>"
    + "|".join([
        r"[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D]\b",  # national insurance
        r"[A-Z]{2}-\d{3}-\d{3}-\d{3}\b",  # card
        r"\d{2}\.?\d{3}\.?\d{3}\s?-?\s?[A-Z]\b|[XYZ]-?\d{7}-?[A-Z]\b",  # Spanish
        r"[1-478]\s?\d\d\s?\d\d\s?\d[\dAB]\s?\d{3}\s?\d{3}(?:\s?\d\d)?\b",  # French
        r"\d{3}[\s-]\d\d[\s-]\d{4}\b",  # social security
        r"\d{2}\s\d{3}\s\d{3}\s\d{3}\b",  # German tax
        r"(?!DNI|NIE|NIF|NIR|SSN|NI)[A-Z]{1,3}[\s-]?\d{6,9}\b",  # passport
        r"[A-Z]{0,3}\d(?:[\s-]?\d){6,14}(?:-?[A-Z])?\b",
    ])
    + "))"
)
#: What must occur in a text, in lower case, for labelled identity numbers to be sought.
_ID_HINTS = (
    "passport", "reisepass", "pasaporte", "passeport", "dni", "nie", "nif", "nir", "ssn", "social", "ni ", "ni:", "nino", "insurance", "steuer",
    "card", "ausweis", "carte", "documento", "tax ",
)
_ID_REACH = 160


def _labelled_ids(text: str, low: str) -> list[tuple[int, int]]:
    """Identity numbers behind a label, sought around the places where a label may be."""
    windows: list[list[int]] = []
    for p in sorted({m for h in _ID_HINTS for m in _occurrences(h, low)}):
        if windows and p - 40 <= windows[-1][1]:
            windows[-1][1] = p + _ID_REACH
        else:
            windows.append([max(0, p - 40), p + _ID_REACH])
    return [m.span("v") for a, z in windows for m in _ID.finditer(text, a, min(z, len(text)))]


def _occurrences(word: str, text: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


_ID_BARE = re.compile(r"(?<![\w-])(?:[A-CEGHJ-PR-TW-Z]{2}\s\d\d\s\d\d\s\d\d\s[A-D]|[XYZ]?\d{7,8}-?[A-HJ-NP-TV-Z])\b")

_PHONE = re.compile(
    r"(?<![\w.,/+-])(?:"
    + "|".join([
        r"(?:\+|00)[1-9]\d{0,2}(?:[\s.-]?\(0\))?(?:[\s./-]?(?:\(\d{1,5}\)|\d{1,10})){1,6}",  # international
        r"\(0\d{1,4}\)[\s/-]?\d{2,8}(?:[\s-]\d{1,6}){0,3}",  # area in brackets
        r"\(\d{3}\)\s?\d{3}[\s.-]\d{4}",
        r"0\d(?:[\s.-]\d\d){4}",
        r"0\d{1,4}[\s/-]\d{2,8}(?:[\s-]\d{1,6}){0,3}",
        r"\d{3}[\s.-]\d{3}[\s.-]\d{4}",
        r"[2-9]\d{2}[2-9]\d{6}",
        r"[679]\d{2}\s\d{3}\s\d{3}",
    ])
    + r")(?![\w/-]|[.,]\d)"
)
#: Words before numbers that are no telephone numbers.
_NO_PHONE = re.compile(r"(?i:barcode|batch|tray|lot|charge(?:nnummer)?|catalogue|cat\.|placa|plaque|plate|platte|platte|form|cell|zelle|maille|celda|with|images|wavelength)\s*:?\s*(?:no\.?\s*)?$")

_CAP = r"[^\W\d_a-zß-öø-ÿ][\w'’-]*"
_PLACE = rf"(?!(?:Tel|Telefon|Fax|Phone|Ausweis|Contact)\b){_CAP}(?:[ ]{_CAP}){{0,2}}"
_STREET = r"(?:road|street|lane|avenue|close|drive|way|terrace|court|crescent|gardens?|grove|place|square|row|mews|walk|hill|green|st|rd|ave|ln)"
#: What must occur in a text, in lower case, for a form of address to be sought.
_ADDRESS_HINTS = (
    (" road", " street", " lane", " avenue", " close", " drive", " way", " terrace", " court", " crescent", " garden", " grove", " place", " square",
     " row", " mews", " walk", " hill", " green", " st", " rd", " ave", " ln"),
    ("weg", "gasse", "straße", "strasse", "str.", "rain", "platz", "allee", "ufer", "ring", "damm", "steig", "graben", "pfad", "stieg",
     "am ", "an der ", "auf der ", "zum ", "zur ", "im ", "in der "),
    ("rue ", "avenue ", "boulevard ", "bd ", "place ", "chemin ", "allée ", "impasse ", "quai ", "route ", "cours ", "passage ", "sentier "),
    ("calle", "avda", "avenida", "plaza", "paseo", "camino", "ronda", "travesía", "c/"),
)
_ADDRESS = [
    re.compile(form)
    for form in (
        rf"\b(?:(?:Flat|FLAT|Apt\.?|Apartment|Unit|Suite)\s\d{{1,4}}[A-Za-z]?,\s)?\d{{1,4}}[A-Za-z]?\s(?:{_CAP}\s){{1,3}}(?i:{_STREET})\b(?:\.(?=,\s{_CAP}))?(?:(?:,\s|\n){_PLACE},?\s\d{{4,6}}\b|,\s{_PLACE}(?![\w@+]))?",
        rf"\b(?:[A-ZÄÖÜ][\w-]*(?i:weg|gasse|straße|strasse|str\.|rain|platz|allee|ufer|ring|damm|steig|graben|pfad|stieg)|(?:Am|An\sder|Auf\sder|Zum|Zur|Im|In\sder|AM|ZUM|IM)\s{_CAP}(?:\s{_CAP})?)\s\d{{1,4}}(?:\s?[a-zA-Z])?\b(?:(?:,\s|\n)\d{{5}}\s{_PLACE})?",
        rf"\b\d{{1,4}}(?:\s?(?:bis|ter|[a-zA-Z]))?,?\s(?i:rue|avenue|boulevard|bd|place|chemin|allée|impasse|quai|route|cours|passage|sentier)\s(?:(?i:de\sla|de\sl['’]|des|du|de|d['’])\s?)?{_CAP}(?:\s{_CAP}){{0,3}}(?:(?:,\s|\n)\d{{5}}\s{_PLACE})?",
        rf"(?:\b(?:Calle|CALLE|Avda\.?|Avenida|AVENIDA|Plaza|PLAZA|Paseo|PASEO|Camino|Ronda|Travesía)|(?<!\w)C/)\s?(?:(?i:del|de\sla|de\slos|de\slas|de)\s)?{_CAP}(?:\s{_CAP}){{0,3}}(?:,)?\s\d{{1,4}}(?:\s?[a-z])?\b(?:(?:,\s|\n)\d{{5}}\s{_PLACE})?",
    )
]

#: Titles, name particles, and the words that introduce a person.
_TITLE = r"(?:Dr|Prof|Mr|Mrs|Ms|Mme|Mlle|Herr|Frau|Sr|Sra|Don|Doña)\.?"
_PARTICLE = r"(?:de[ ]la|van[ ]der|van[ ]den|von[ ]der|von|van|del|de|di|da|dos|le|la)"
_WORD = r"[^\W\d_][\w'’-]*[^\W_]"
_PROPER = r"[^\W\d_a-zß-öø-ÿ][\w'’-]*[^\W\d_]"
#: Phrases right before a person, without a first letter that may be large or small, and labels with a colon.
_PHRASES = (
    "arvested by", "ollected by", "igned by", "ounted by", "repared by", "According to", "Ship to", "Thanks to", "e asked", "together with", "label read", "after lunch",
    "Colis pour", "Paquete para", "montés par", "montados por", "wurden von", "Probe von", "Laut", "Selon", "Según",
)
_LABELS = ("Sample owner", "Contact", "Contacto", "Ansprechpartner", "Kontakt")
_PERSON = (
    rf"\s(?:{_TITLE}\s)?(?P<given>(?!{_TITLE}\s){_PROPER})[ ](?:[A-Z]\.?[ ])?(?P<surname>(?:{_PARTICLE}[ ])?{_PROPER})"
    r"(?=[ ](?:and|und|et|y|noted|opened|for|during|war|hat|to)\b|[,.(:]|[ ]\(|\n|$)"
)
_BEHIND = re.compile(_PERSON)
_BEHIND_LABEL = re.compile(rf"\s?:{_PERSON}")


def _phrased(text: str) -> Iterator[re.Match]:
    """The person behind each phrase and label, in order of the phrases."""
    for words, form in ((_PHRASES, _BEHIND), (_LABELS, _BEHIND_LABEL)):
        for w in words:
            for at in _occurrences(w, text):
                before = at - 1 if w[0].islower() and at and text[at - 1] in "HhCcSsMmPpWw" else at
                if (before == 0 or not (text[before - 1].isalnum() or text[before - 1] == "_")) and (m := form.match(text, at + len(w))):
                    yield m


_WORDS = re.compile(_WORD)
_HEAD = re.compile(rf"{_PARTICLE}[ ]", re.I)
_BEFORE = re.compile(rf"(?P<given>{_WORD})(?:[ ](?P<middle>[^\W\d_]\.?))?[ ]$")
_INITIALS = re.compile(r"(?<!\w)(?P<initials>[^\W\d_]\.(?:[^\W\d_]\.)?)[ ]$")
_AFTER = re.compile(rf",[ ](?P<given>{_WORD})(?P<middle>[ ][^\W\d_]\.)?(?![\w@+.-]*@|[-+.]\w|[ ]@)")


_FULL = re.compile(rf"{_PROPER}[ ](?:[A-Z]\.?[ ])?(?P<surname>(?:{_PARTICLE}[ ])?{_PROPER})(?=[,.;:)(\n]|$|[ ][a-zß-öø-ÿ(])")


class _Either:
    def __init__(self, a: Collection[str], b: Collection[str]):
        self.a, self.b = a, b

    def __contains__(self, name: str) -> bool:
        return name in self.a or name in self.b


class Names:
    """A lexicon of given names and of surnames, the latter by their last word with the particles that go before it."""

    def __init__(self, given: Collection[str], surnames: Iterable[str], shared: Names | None = None):
        """With `shared`, the names of a larger lexicon count too; it is looked up and not copied."""
        self.given = given if shared is None else _Either(given, shared.given)
        self.last: dict[str, set[str]] = {} if shared is None else ChainMap({}, shared.last)
        for s in surnames:
            head, _, tail = s.rpartition(" ")
            self.last[tail] = {*self.last.get(tail, ()), head}

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Mentions in order: surnames with what belongs to them, and given names before a proper word that no text introduced."""
        taken = -1
        for m in _WORDS.finditer(text):
            word = m.group().lower()
            heads = self.last.get(word)
            if m.start() < taken:
                continue
            if heads is None and word in self.given and (new := _FULL.match(text, m.start())):
                surname = new["surname"].lower()
                if self.last.get(surname.rpartition(" ")[2]) is None:
                    # a word that the text also writes in lower case is no name
                    if not re.search(rf"(?<!\w){re.escape(surname)}(?!\w)", text):
                        taken = new.end("surname")
                        yield m.start(), taken
                        continue
            if heads is None:
                continue
            a, b = m.span()
            if text[b : b + 1] in ("@", "+", "_") or (a and text[a - 1] in "@+_.-/"):
                continue
            for head in sorted(heads, key=len, reverse=True):
                if head and text[:a].lower().endswith(head + " ") if len(text) < 200 else head and text[max(0, a - len(head) - 1) : a].lower() == head + " ":
                    a -= len(head) + 1
                    break
            else:
                if "" not in heads:
                    continue
            offset = max(0, a - 48)
            before = _BEFORE.search(text[offset:a])
            led = False
            if before and before["given"].lower() in self.given:
                a, led = offset + before.start("given"), True
            elif initials := _INITIALS.search(text[offset:a]):
                start = offset + initials.start("initials")
                if not re.search(r"\d\s*$", text[max(0, start - 3) : start]):
                    a, led = start, True
            if not led and (after := _AFTER.match(text, b)) and after["given"].lower() in self.given:
                b = after.end("middle") if after["middle"] else after.end("given")
            if a < taken:
                continue
            taken = b
            yield a, b


#: A title before a surname, or before a full name that a mark or the end of the line follows.
_TITLED = re.compile(
    rf"\b(?:Dr|Prof|Mr|Mrs|Ms|Mme|Mlle|Herr|Frau|Herrn|Sr\.|Sra\.|Don|Doña)\.?[ ]"
    rf"(?:(?P<given>{_PROPER})[ ](?:[A-Z]\.?[ ])?(?P<surname>(?:{_PARTICLE}[ ])?{_PROPER})(?=[,.;:)(\n]|$)|(?P<alone>(?:{_PARTICLE}[ ])?{_PROPER})(?![ ]?[^\W\d_a-zß-öø-ÿ]|[\w@-]))"
)
#: What closes a letter before the name of its writer.
_CLOSING = (
    r"(?:(?:[Bb]est|[Kk]ind|[Ww]arm)(?:[ ](?:regards|wishes))?|[Rr]egards|[Cc]heers|[Ss]incerely|[Yy]ours(?:[ ]\w+)?|(?:[Mm]it[ ])?(?:freundlichen?|besten?|[Vv]iele)[ ]Grüße[n]?|Grüße|Gruß|"
    r"[Cc]ordialement|[Bb]ien[ ]à[ ](?:vous|toi)|[Aa]mitiés|[Ss]aludos(?:[ ]cordiales)?|[Uu]n[ ]saludo|[Aa]tentamente)"
)
#: What must occur in a text for titles and closings to be sought.
_TITLES = ("Dr", "Prof", "Mr", "Ms", "Mme", "Mlle", "Herr", "Frau", "Sr.", "Sra.", "Don ", "Doña")
_CLOSINGS = ("egards", "ishes", "est,", "heers", "incerely", "ours", "Grüße", "Gruß", "ordialement", "ien à", "mitiés", "aludo", "tentamente")
_SIGNED = re.compile(rf"(?:^|[\n.!?;][ ]?){_CLOSING},?\s+(?P<given>{_PROPER})[ ](?:[A-Z]\.?[ ])?(?P<surname>(?:{_PARTICLE}[ ])?{_PROPER})(?=[ ]*(?:[,.\n(]|$))", re.M)
_PAIR = re.compile(rf"(?<![\w@.'-])(?P<given>{_WORD})[ ](?:[A-Z]\.?[ ])?(?P<surname>(?:{_PARTICLE}[ ])?{_WORD})(?![\w@])")


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if c.isalpha())


def _spelled_by_mail(text: str, mails: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, str]]:
    """Neighbouring words that a mail address in the same text spells as a given name, or its initial, and a surname."""
    whole = [re.split(r"[@+]", text[a:b])[0].lower() for a, b in mails]
    locals_ = {x for x in map(_folded, whole) if len(x) > 4}
    # parts that must stand outside the addresses
    parts = {p for x in whole for p in map(_folded, [*re.split(r"[._-]", x), x[1:], x[:-1]]) if len(p) > 2}
    text = _blanked(text, mails)
    bare = text.lower().replace("'", "").replace("’", "").replace("-", "")
    if not bare.isascii():
        bare = unicodedata.normalize("NFKD", bare).encode("ascii", "ignore").decode()
    joined = bare.replace(" ", "")
    if not (any(p in bare for p in parts) or any(x in joined for x in locals_)):
        return
    place = 0
    while m := _PAIR.search(text, place):
        given, surname = _folded(m["given"]), _folded(m["surname"])
        if len(surname) > 2 and len(given) > 1 and not locals_.isdisjoint((given + surname, surname + given, given[0] + surname, surname + given[0])) and m["given"][0].isupper() and m["surname"].rpartition(" ")[2][0].isupper():
            yield m.start("given"), m.end("surname"), m["given"], m["surname"]
            place = m.end()
        else:
            place = m.end("given")


def introduced(text: str, mails: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, str | None, str]]:
    """(start, end, given name or None, surname) of each place that shows a person: a phrase, a title, a signature, an address spelled like the words."""
    for m in _phrased(text):
        yield m.start("given"), m.end("surname"), m["given"], m["surname"]
    for m in _TITLED.finditer(text) if _any(_TITLES, text) else ():
        if m["alone"]:
            yield *m.span("alone"), None, m["alone"]
        else:
            yield m.start("given"), m.end("surname"), m["given"], m["surname"]
    for m in _SIGNED.finditer(text) if _any(_CLOSINGS, text) else ():
        yield m.start("given"), m.end("surname"), m["given"], m["surname"]
    yield from _spelled_by_mail(text, _emails(text) if mails is None else mails)


def _parts_of(found: Iterable[tuple[int, int, str | None, str]]) -> set[tuple[str, str]]:
    """(part, name) in lower case: g for given names, s for surnames."""
    return {pair for _, _, g, s in found for pair in (("g", g.lower() if g else None), ("s", s.lower())) if pair[1]}


def _without_names(source: str) -> tuple[Plain, list[tuple[int, int, str]], str]:
    """The plain form, the mentions in it other than names, and the plain form with those blanked."""
    plain = Plain(source)
    text = plain.text
    found: list[tuple[int, int, str]] = []
    free = text

    def take_all(kind: str, spans: list[tuple[int, int]]) -> None:
        nonlocal free
        if spans:
            free = _blanked(free, spans)
            found.extend((a, b, kind) for a, b in spans)

    low = text.lower()
    if len(low) != len(text):  # letters whose lower form is longer
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    take_all("email", _emails(text))
    take_all("id_number", _labelled_ids(free, low))
    take_all("id_number", [m.span() for m in _ID_BARE.finditer(free)])
    for hints, form in zip(_ADDRESS_HINTS, _ADDRESS):
        if _any(hints, low):
            take_all("address", [m.span() for m in form.finditer(free)])
    phones = []
    for m in _PHONE.finditer(free):
        digits = sum(c.isdigit() for c in m.group())
        if 9 <= digits <= 15 and not _NO_PHONE.search(free[max(0, m.start() - 24) : m.start()]):
            phones.append(m.span())
    phones += [(a, b) for a, b in plain.spelled if 9 <= b - a <= 15 and "\x00" not in free[a:b] and not any(x < b and a < y for x, y in phones)]
    take_all("phone", sorted(phones))
    return plain, found, free


def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
    parts, place = [], 0
    for a, b in spans:
        parts += [text[place:a], "\x00" * (b - a)]
        place = b
    return "".join([*parts, text[place:]])


def find_mentions(source: str | None, names: Names) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every mention, in order of place."""
    if not source:
        return []
    plain, found, free = _without_names(source)
    mails = [(a, b) for a, b, kind in found if kind == "email"]
    shown = list(introduced(plain.text, mails))
    own = _parts_of(shown)
    if own:
        names = Names({n for p, n in own if p == "g"}, {n for p, n in own if p == "s"}, names)
    spans = list(names.spans(free))
    taken = [(a, b) for a, b, _ in found]
    for a, b, _, _ in shown:  # what the lexicon did not find there
        if all(b <= x or y <= a for x, y in (*spans, *taken)):
            spans.append((a, b))
    return [(kind, *plain.source_span(a, b)) for a, b, kind in sorted([*found, *((a, b, "name") for a, b in spans)])]


def asked_names(source: str) -> set[tuple[str, str]]:
    """(part, name) of every name that `find_mentions` may look up in a text; of surnames their last word, part s."""
    text = _without_names(source)[2]
    asked = set()
    for m in _WORDS.finditer(text):
        a, b = m.span()
        asked.add(("s", m.group().lower()))
        starts = [a, *(a - n for n in range(3, min(a, 8) + 1) if _HEAD.fullmatch(text, a - n, a))]  # before a particle too
        given = [_BEFORE.search(text[max(0, x - 48) : x]) for x in starts] + [_AFTER.match(text, b)]
        asked |= {("g", g["given"].lower()) for g in given if g}
    return asked


def learn_names(df: DataFrame, text: str) -> DataFrame:
    """(part, name): names introduced in at least MIN_NAME_ROWS texts; counted over all texts, combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    counts.update(_parts_of(introduced(Plain(t).text)))
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["part", "name", "n"])

    counted = df.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "part string, name string, n bigint").groupBy("part", "name").agg(F.sum("n").alias("n"))
    return written(counted.where(F.col("n") >= MIN_NAME_ROWS).select("part", "name"), "names")


def _by_part(rows: Iterable) -> Names:
    rows = list(rows)
    return Names({r["name"] for r in rows if r["part"] == "g"}, {r["name"] for r in rows if r["part"] == "s"})


def _named(df: DataFrame, key: str, text: str) -> tuple[DataFrame, Names | None]:
    """(rows, names): (key, text) and one lexicon for all of them, or None and in a third column the names each text may hold."""
    narrow = spread(df.select(F.col(key), F.col(text)))
    learned = learn_names(narrow, text)
    if (rows := bounded_rows(learned, MAX_NAMES)) is not None:
        return narrow, _by_part(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pairs = sorted(asked_names(t))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(pairs), pa.string()), pa.array([f"{p} {n}" for p, n in pairs], pa.string())], names=["_digest", "_asked"])

    digest = F.sha2(F.col(text), 256)
    texts = narrow.where(F.col(text) != "").groupBy(digest.alias("_digest")).agg(F.min(text).alias("_text"))
    asked = texts.mapInArrow(run, "_digest string, _asked string")
    last = F.when(F.col("part") == "s", F.substring_index("name", " ", -1)).otherwise(F.col("name"))
    known = learned.groupBy(F.concat_ws(" ", "part", last).alias("_asked")).agg(F.collect_set(F.struct("part", "name")).alias("_names"))
    own = heavy_light_join(written(asked, "asked"), known, "_asked", "inner").groupBy("_digest").agg(F.flatten(F.collect_set("_names")).alias("_names"))
    return narrow.withColumn("_digest", digest).join(own, "_digest", "left").select(key, text, "_names"), None


def _finder(names: Names | None) -> Callable[[pa.RecordBatch], Iterator[tuple[str | None, list[tuple[str, int, int]]]]]:
    """Texts with their mentions of each batch of what `_named` gives."""

    def run(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[tuple[str, int, int]]]]:
        if names is not None:
            for t in batch.column(1).to_pylist():
                yield t, find_mentions(t, names)
        else:
            for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                yield t, find_mentions(t, _by_part(n or []))

    return run


def mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, start_pos, end_pos): one row per mention."""
    ship_code(df.sparkSession)
    narrow, lexicon = _named(df, key, text)
    names = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(names.value)
        for b in batches:
            keys, kinds, starts, ends = [], [], [], []
            for k, (_, found) in enumerate(find(b)):
                for kind, a, z in found:
                    keys.append(k)
                    kinds.append(kind)
                    starts.append(a)
                    ends.append(z)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "kind", "start_pos", "end_pos"])

    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[0].dataType.simpleString()}, kind string, start_pos int, end_pos int")


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, n_mentions): the text with each mention replaced by its kind in brackets, otherwise unchanged."""
    ship_code(df.sparkSession)
    narrow, lexicon = _named(df, key, text)
    names = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(names.value)
        for b in batches:
            texts, counts = [], []
            for t, found in find(b):
                parts, place = [], 0
                for kind, a, z in found:
                    parts += [t[place:a], f"[{kind.upper()}]"]
                    place = z
                texts.append(None if t is None else "".join([*parts, t[place:]]))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[key, "text", "n_mentions"])

    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[0].dataType.simpleString()}, text string, n_mentions int")
