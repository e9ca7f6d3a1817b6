"""Personal information inside free text: information-theoretic sanitisation.

One pass over the documents proposes candidates by neutral form: runs of digits, words joined by signs of mail, capitalised
words beside a number, neighbouring capitalised words. Each candidate has *terms* that stand for it (a digit shape, the skeleton
of a mail address, the word for a street or the phrase, the words of a name in their roles). What protected entities there are
is known at first only from seeds: labels such as "Tel.", words for streets, listed names. Corpus co-occurrence over all
documents then estimates how strongly a term reveals an entity:

    disclosure(term) = PMI(term; entity) / IC(entity) = 1 - ln p(entity | term) / ln p(entity)

the share of the entity's information content that the term gives away; ``p(entity)`` is its rate among all words of the
corpus. A candidate whose terms all reach the one threshold ``DISCLOSURE`` is protected wherever it stands, and generalised to
a typed placeholder; all others stay in the text.

* number: how often its digit shape stands behind a label of a phone or a document, of all places of the shape. A number with
  such a label of its own reveals it whatever its shape (the label is the entity); behind a label of a thing it reveals nothing.
* address: how often a street word or phrase stands in frames (the two words before) in which seed street words stand.
* mail: how often a skeleton has a listed name or a mail label with it.
* name: how many of the different words that a word stands beside are listed in the other role, one left out as it may be
  chance; a listing of its own counts as ``LISTED`` such partners. Each part of a name must reveal it.

Statistics cover all documents; nothing is sampled. The candidates, a few short rows per document, are written once to the
shared folder. Terms are few (shapes, phrases, names), their counts are aggregated map-side.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltarill.llm.leaks import _HIGH, _sloppy_bytes, form
from deltarill.session import materialize, release, ship

#: share of an entity's information content from which on a term gives it away
DISCLOSURE = 0.8
#: different partners that a listing of a name is worth as evidence
LISTED = 20
#: what is added to the places of a term and to its hits, and to the words of the corpus, so that few observations prove little
_PLACES, _HITS, _WORDS = 0.5, 0.01, 1000
#: nats of evidence from which on letters are read in another code page
CODE_PAGE = 5.0

#: names a list may have
MAX_LISTED = 200_000
#: terms that a task may hold when texts are redacted in place
MAX_TERMS = 1_000_000

KINDS = ("name", "email", "phone", "id", "address")

# ---------------------------------------------------------------- text as it was meant, with places in the text as it is

_RUN = re.compile("(?:[Â-ô][" + re.escape(_HIGH) + "\u0080-¿]{1,3})+")
_ENTITY = re.compile(r"&(?:#\d{1,6}|#x[0-9a-fA-F]{1,5}|[a-zA-Z]{2,8});")
_COMMON_RU = frozenset("оеаинтсрвл")


def _replaced(text: str, at: list[int] | None, pattern: re.Pattern, new) -> tuple[str, list[int] | None]:
    """``text`` with matches replaced, and for each sign of it the place where it begins in the first text."""
    out, places, last = [], [], 0
    for m in pattern.finditer(text):
        s = new(m)
        if s == m.group():
            continue
        where = at if at is not None else range(len(text) + 1)
        out += [text[last : m.start()], s]
        places += where[last : m.start()]
        places += [where[m.start()]] * len(s)
        last = m.end()
    if not out:
        return text, at
    where = at if at is not None else range(len(text) + 1)
    places += where[last:]
    return "".join(out) + text[last:], list(places)


def _utf8(m: re.Match) -> str:
    try:
        return _sloppy_bytes(m.group()).decode("utf-8")
    except (UnicodeError, ValueError):
        return m.group()


_TABLES: dict[str, dict[int, str]] = {}


def _table(wrong: str, right: str) -> dict[int, str]:
    key = wrong + right
    if key not in _TABLES:
        t = {}
        for b in range(128, 256):
            try:
                t[ord(bytes([b]).decode(wrong))] = bytes([b]).decode(right)
            except UnicodeError:
                continue
        _TABLES[key] = t
    return _TABLES[key]


def meant(text: str) -> tuple[str, list[int] | None]:
    """The text as it was meant (entities, UTF-8 read as one byte a sign, Cyrillic read in another code page) and the places of its signs, or None if unmoved."""
    at = None
    if "&" in text:
        text, at = _replaced(text, at, _ENTITY, lambda m: html.unescape(m.group()))
    if text.isascii():
        return text, at
    for _ in range(2):
        before = text
        text, at = _replaced(text, at, _RUN, _utf8)
        if text is before:
            break
    return _code_page(text), at


#: fixed value: how likely a letter of Russian text is one of the common small ones, and a letter of any other text
_P_RU, _P_ANY = 0.62, 0.3
_HIGH_RUN = re.compile("[\u0080-\u024fЀ-ӿ]{3,}")
_PAGES = (("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "cp1251"), ("latin-1", "koi8-r"))


def _code_page(text: str) -> str:
    """Cyrillic that was read in another code page as itself, where the letters give at least ``CODE_PAGE`` nats of evidence for it.

    Words without any ASCII letter are the evidence, whatever the length of the text. They alone are replaced where most high
    letters stand in words of other letters, as in a text of several languages; else the whole text is.
    """
    runs = "".join(_HIGH_RUN.findall(text))
    if not runs:
        return text
    best, score = None, _ru(runs) + CODE_PAGE
    for wrong, right in _PAGES:
        t = _table(wrong, right)
        s = _ru(runs.translate(t))
        if s > score:
            best, score = t, s
    if best is None:
        return text
    if 2 * len(runs) >= sum(c > "\x7f" and c.isalpha() for c in text):
        return text.translate(best)
    return _HIGH_RUN.sub(lambda m: m.group().translate(best), text)


def _ru(signs: str) -> float:
    """Nats of evidence that letters are Russian: common small ones speak for it, others against it."""
    letters = sum(map(str.isalpha, signs))
    common = sum(map(signs.count, _COMMON_RU))
    return common * math.log(_P_RU / _P_ANY) + (letters - common) * math.log((1 - _P_RU) / (1 - _P_ANY))


_TIMES = re.compile(r"^[^\n]*-->[^\n]*$|^[ \t﻿]*\d+[ \t\r]*$|\n[ \t\r]*(?=\n)|\{\d+\}\{\d+\}", re.M)
_TAGS = re.compile(r"</?[a-zA-Z][^<>\n]{0,60}>|\{\\[^{}\n]{0,20}\}")


def masked(text: str, cue_format: str | None) -> str:
    """The text with cue ends, numbers and times as control signs and line breaks as blanks, of the same length."""
    m = _TIMES.sub(lambda x: "\x1e" * len(x.group()), text)
    if "<" in m or "{" in m:
        m = _TAGS.sub(lambda x: "\x1f" * len(x.group()), m)
    m = m.replace("\x1e\n", "\x1e\x1e").replace("\n\x1e", "\x1e\x1e").replace("\n", " ").replace("\r", " ")
    if cue_format == "sub" or text[:1] == "{" or text[1:2] == "{":
        m = m.replace("|", " ")
    return m


# ---------------------------------------------------------------- candidates

# fixed values: how addresses of mail are spelled out
_W = r"[A-Za-z0-9_+!]+"
_EMAIL = re.compile(
    rf"(?<![\w.@+-])(?:{_W}(?:[.,](?=\w)|- {{0,2}}))*{_W}"
    rf"(?: {{0,2}}(?:@|[\[(](?:at|al|ot)[\])]) {{0,2}}(?:{_W}(?:[.,]|- {{0,2}}| {{0,2}}[\[(](?:dot|d0t|clot|dol)[\])] {{0,2}}))+{_W}"
    rf"| {{1,2}}at {{1,2}}(?:{_W}(?:[.]|-| {{1,2}}(?:dot|d0t|clot|dol) {{1,2}}))*{_W} {{1,2}}(?:dot|d0t|clot|dol) {{1,2}}{_W})",
    re.I,
)
# words joined by "at" alone, and handles: joined like mail, but no mail
_JOINED = re.compile(r"(?<![\w.@])(?:[A-Za-z0-9_]+ {1,2}at {1,2}[A-Za-z0-9_]+|@[A-Za-z0-9_]+)(?![\w@])", re.I)
# fixed values: words that name mail
_MAIL_WORD = re.compile(r"mail|correo|courriel|почт", re.I)
_B = r" {1,4}"
# a number: parts with digits, joined by single separators; parts may have misread digits and letters of an id
_PART = r"(?:[A-Z]{1,2}[0-9][0-9OoIlSBT!]*(?:[A-Z]{1,2}[0-9OoIlSBT]*)?[A-Z]?(?![a-z0-9])|(?:[0-9]|[OIlSB!]{1,3}(?=[0-9]))[0-9OoIlSBT!]*(?:[A-Z]{1,2}[0-9OoIlSBT]*)?(?![a-z0-9]))"
_NUMBER = re.compile(
    rf"(?<![\w@#/:+.,$€&-])(?:\( ?\+ ?|\+|\()?(?:(?!ID|NR|NO)[A-Z]{{1,2}}(?:-| {{1,3}})(?=[0-9]))?(?=[0-9OIlSB(]*[0-9]|[A-Z]{{1,2}}[0-9]){_PART}"
    rf"(?:(?:\){_B}|\)|{_B}\(|-\(|-(?: {{1,3}})?|[./,]|{_B}){_PART}){{0,9}}(?:(?:-|{_B})?[A-Z](?![\w'’]))?"
)
# fixed values: words that name a phone or a document of a person before the number, and words of numbers that are things
_LABEL_WORD = re.compile(
    r"(?P<phone>\btel\b|t[eé]l\b|\bтел\b|\bcall\b|phone|\btext\b|\bruf\b|appelle|ll[aá]m|звон|m[oó]vil|mobil|handy|whatsapp|\bfax\b)"
    r"|(?P<id>\bssn\b|social security|insurance|passport|taxpayer|\btax\b|\bid\b|ausweis|steuer|reisepass|personal|sécurité sociale|s.curit. sociale|identit|passeport|\bdni\b|\bnie\b|\bnif\b|documento|снилс|паспорт|\bинн\b)"
    r"|(?P<thing>order|flight|\bcase\b|ticket|serial|room|page|version|code|cost|crown|dial|line|column|floor|\bfps\b|vuelo|pedido|vol\b|commande|flug|bestell|заказ|рейс)"
)
# fixed values: the end of a sentence, but for abbreviations of labels
_STOP = re.compile(r"(?<!\btel)(?<!\bt.l)(?<!тел)(?<!\bnr)[.!?] ")

# fixed values: digits as words
_DIGIT_WORDS = (
    "oh o zero nought one two three four five six seven eight nine double triple "
    "null eins zwei zwo drei vier fünf sechs sieben acht neun zéro un deux trois quatre cinq sept huit neuf "
    "cero uno dos tres cuatro cinco seis siete ocho nueve ноль один два три четыре пять шесть семь восемь девять"
).split()
# fixed values: titles, which are no part of a name and never learned as one
_TITLES = frozenset(form(w) for w in (
    "mr mrs ms miss mister sir madam lady lord dr prof herr frau fräulein monsieur madame mademoiselle mme "
    "señor señora señorita don doña господин госпожа товарищ"
).split())
_DIGIT_FORMS = frozenset(form(w) for w in _DIGIT_WORDS)
#: words of digits from which on they are looked at as one number, and digits likewise
SPELLED = 2
DIGITS = 5

_CAP = "A-ZÀ-ÖØ-ÞŸŁŚŠŽА-ЯЁΑ-Ω╟╔╓"
_NO = r"\d{1,4}"
_X = r"[^\s\d,.;:!\"()\[\]\x1e\x1f]"  # a sign within a word, damaged or not
# fixed values: words for streets
_EN_TYPE = r"(?P<en_t>Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Way|Close|Drive|Dr|Place|Square|Terrace|Row|Crescent|Boulevard|Blvd)"
_FR_TYPE = r"(?P<fr_t>(?i:rue|quai|avenue|av\.|bd\.?|boulevard|impasse|place|chemin|all.{1,2}e|cours|route|passage|square))"
_ES_TYPE = r"(?P<es_t>(?i:calle|avenida|avda\.|av\.|plaza|paseo|camino|ronda|carretera|C/|pza\.))"
_RU_TYPE = r"(?P<ru_t>(?i:улица|ул\.|проспект|пр\.|пр-т|переулок|пер\.|площадь|пл\.|набережная|наб\.|бульвар|шоссе))"
_DE_END = r"(?:stra.{1,2}e|str\.?|weg|gasse|platz|allee|ufer|ring|damm)"
_STREET = re.compile(
    rf"(?P<en>(?<![\w.,-])[0-9lIO][0-9O]{{0,3}}[A-Za-z]?(?:,{_B}|{_B})(?:(?:North|South|East|West|Old|New|Upper|Lower|Great|Little){_B})?[{_CAP}][\w'’?�!-]*(?:{_B}[{_CAP}][\w'’?�!-]*)?{_B}{_EN_TYPE}\b(?:(?:(?<=St)|(?<=Rd)|(?<=Ln)|(?<=Ct)|(?<=Dr)|(?<=Ave)|(?<=Blvd))\.)?)"
    rf"|(?P<fr>(?<![\w.,-]){_NO}(?:{_B}(?:bis|ter|quater)|[A-Za-z])?(?:,{_B}|{_B}){_FR_TYPE}{_B}(?:(?:de{_B}la|de{_B}l['’]|des|du|de|d['’]|la|le|les)(?:{_B})?)?[{_CAP}]{_X}*(?:{_B}[{_CAP}]{_X}*)*)"
    rf"|(?P<es>(?<!\w){_ES_TYPE}{_B}(?:(?:de{_B}la|de{_B}los|de{_B}las|del|de|la){_B})?[{_CAP}]{_X}*(?:{_B}[{_CAP}]{_X}*)*(?:,{_B}|{_B})(?:n\.? ?.{{1,2}}{_B}|n[uú]m\.{_B})?{_NO}(?:(?:{_B})?bis|[A-Za-z])?(?!\w))"
    rf"|(?P<ru>(?<!\w){_RU_TYPE}{_B}[{_CAP}][\w-]*(?:{_B}[{_CAP}][\w-]*)*(?:,{_B}|{_B})(?:(?:д\.|дом)(?:{_B})?)?{_NO}(?:(?:{_B})?[а-яА-Я](?![\w.]))?(?:/\d+)?(?!\w))"
    rf"|(?P<de>(?<!\w)(?:[{_CAP}][\w?�-]*{_B})?(?:[{_CAP}][\w?�-]*{_DE_END}|Stra.{{1,2}}e|Str\.|Weg|Gasse|Platz|Allee){_B}{_NO}(?:(?:{_B})?[a-z](?!\w))?(?!\w|[.,:]\d))"
)
# phrases without a word for a street: before a number, and behind one
_PHRASE = re.compile(rf"(?<!\w)(?P<phrase>[{_CAP}][\w?�-]+(?:{_B}[{_CAP}][\w?�-]+){{0,2}})(?:,{_B}|{_B}){_NO}(?:(?:{_B})?[a-z](?![\w'’]))?(?!\w|[.,:/-]\d|{_B}\d)")
_AHEAD = re.compile(rf"(?<![\w.,:/-]){_NO}[A-Za-z]?(?:,{_B}|{_B})(?P<phrase>[{_CAP}][\w'’?�-]+(?:{_B}[{_CAP}][\w'’?�-]+){{1,2}})")

_CUE = re.compile(r"[^\x1e]+")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"[\[(][ao][tl][\])]| at ", re.I)
_TOKEN = re.compile(r"[^\s,;:!?\"“”„«»()\[\]<>{}|…\x1e\x1f/]+(?:[!?](?=\w)[^\s,;:!?\"“”„«»()\[\]<>{}|…\x1e\x1f/]+)*")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_MISREAD = re.compile(r"[OoIlSBT!](?=[0-9OoIlSBT!]*[0-9])|(?<=[0-9])[OoIlSBT!]")
_INITIAL = re.compile(r"[^\W\d_]\.?\Z")


def shape(found: str) -> str:
    """Digits as 9, letters as Z; a misread digit among digits is a digit; blanks one each."""
    s = re.sub(r" +", " ", found)
    out = []
    for i, c in enumerate(s):
        near = s[max(0, i - 1) : i] + s[i + 1 : i + 2]
        if c.isdigit():
            out.append("9")
        elif c in "OoIlSBT!" and (any(x.isdigit() for x in near) or c in "o!l"):
            out.append("9?" if c in "SBTI" else "9")
        elif c.isalpha():
            out.append("Z")
        else:
            out.append(c)
    t = "".join(out)
    # a letter beside digits may be a sign of an id: only within runs of digits on both sides is it surely a digit
    t = re.sub(r"(?<=9)9\?(?=9)", "9", t).replace("9?", "Z")
    return t


class Candidate:
    """A piece that may be personal data: its kind, span in the text as meant, terms, and what is known of its place.

    ``terms`` must all disclose; ``shape`` is a term that speaks for one cut of a number rather than another; ``cue`` is the
    label or frame; ``seed`` the evidence of the place; ``group`` and ``cut`` tell the readings of one piece apart.
    """

    __slots__ = ("kind", "a", "b", "terms", "shape", "cue", "seed", "group", "cut", "ra", "rb")

    def __init__(self, kind: str, a: int, b: int, terms: tuple, shape: str = "", cue: str = "", seed: int = 0, group: int = 0, cut: int = 0):
        self.kind, self.a, self.b, self.terms, self.shape, self.cue, self.seed, self.group, self.cut = kind, a, b, terms, shape, cue, seed, group, cut


def _lead(token: str) -> int:
    return len(token) - len(token.lstrip("-–—*_~#♪¿¡`'’"))


def _unaccented(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if c.isalnum())


class Finder:
    """Candidates of a document. ``listed`` maps the form of a name to its roles (``g``, ``f``)."""

    def __init__(self, listed: dict[str, str], spelled: frozenset[str] = frozenset()):
        self.listed = listed
        self.spelled = spelled  # listed names without accents, as they are written in mail
        self.known: dict[str, tuple[str, str]] = {}
        self.words = 0

    def _name(self, token: str) -> tuple[str, str]:
        """Form and listed role ('' if not listed) of a capitalised token; '-' for none."""
        k = self.known.get(token)
        if k is None:
            core = token.strip(".'’-–—*_~#♪¿¡`")
            first = core[:1]
            if len(core) < 2 or not (first.isupper() or (first.isalpha() and not first.islower()) or (not first.isascii() and not first.islower())):
                k = ("-", "d" if core and form(core) in _DIGIT_FORMS else "")
            else:
                f = form(core.replace("’", "'"))
                k = (f, self.listed.get(f, ""))
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[token] = k
        return k

    def find(self, raw: str, cue_format: str | None) -> list[Candidate]:
        """All candidates, with their spans ``ra``, ``rb`` in the raw text."""
        text, at = meant(raw)
        m = masked(text, cue_format)
        out: list[Candidate] = []
        taken: list[tuple[int, int]] = []
        # only cues that hold a digit or a sign of mail can hold anything but names
        for c in _CUE.finditer(m):
            part = c.group()
            lo, hi = c.span()
            if "@" in part or _AT.search(part):
                self._mails(m, lo, hi, out, taken)
            if _DIGIT.search(part):
                self._streets(m, lo, hi, out, taken)
                self._numbers(m, lo, hi, out, taken)
        self._names(m, out)
        for c in out:
            c.ra, c.rb = (c.a, c.b) if at is None else (at[c.a], at[c.b] if c.b < len(at) else len(raw))
        return out

    def _mails(self, m: str, lo: int, hi: int, out: list, taken: list) -> None:
        for x in _EMAIL.finditer(m, lo, hi):
            taken.append(x.span())
            out.append(self._mail(m, lo, x))
        for x in _JOINED.finditer(m, lo, hi):
            if not any(x.start() < t and s < x.end() for s, t in taken):
                out.append(self._mail(m, lo, x))

    def _mail(self, m: str, lo: int, x: re.Match) -> Candidate:
        """A mail address by its skeleton: words as ``w``, signs between them in one form."""
        s = x.group()
        w = [form(p) if i % 2 else p for i, p in enumerate(re.split(r"([A-Za-z0-9_+!]+)", s))]
        joins = "".join(p if i % 2 == 0 else "@" if p == "ol" else "." if p == "clol" else "w" for i, p in enumerate(w))
        skeleton = re.sub(r"w(?:[.,-]w)+", "w", re.sub(r" *([@.]) *", r"\1", re.sub(r"[\[\]()]", "", joins)))
        if skeleton.startswith("@") or ("." not in joins and "," not in joins):
            skeleton = joins
        local = _unaccented(re.split(r"@| ?[\[(]| at ", s)[0])
        named = any(local[i:] in self.spelled or local[:i] in self.spelled for i in range(len(local) + 1)) or any(
            _unaccented(p) in self.spelled for p in re.split(r"[^A-Za-z]+", s))
        labelled = _MAIL_WORD.search(m, max(lo, m.rfind(". ", lo, x.start())), x.start())
        return Candidate("email", *x.span(), ("mail " + skeleton,), seed=1 if named or labelled else 0)

    def _streets(self, m: str, lo: int, hi: int, out: list, taken: list) -> None:
        for x in _STREET.finditer(m, lo, hi):
            kind = x.lastgroup
            a, b = x.span()
            taken.append((a, b))
            if kind == "de":
                words = re.split(r" +", re.split(r" {1,4}\d", x.group())[0])
                end = re.search(_DE_END + r"\Z", words[-1], re.I)
                typed = "de " + form(end.group() if end else words[-1])
                self._phrase(m, lo, a, b, words, typed, 1 if end and end.start() else 0, 1, out)
            else:
                out.append(Candidate("address", a, b, (kind + " " + form(x.group(kind + "_t").strip(".")),), cue=self._left(m, lo, a), seed=1, group=a))
        for pattern in (_PHRASE, _AHEAD):
            for x in pattern.finditer(m, lo, hi):
                a, b = x.span()
                if any(a < t and s < b for s, t in taken):
                    continue
                words = re.split(r" +", x.group("phrase"))
                if pattern is _PHRASE:
                    self._phrase(m, lo, a, b, words, "", 1, 0, out)
                else:
                    out.append(Candidate("address", a, b, ("ahead " + form(words[-1]),), cue=self._left(m, lo, a), group=a))

    def _phrase(self, m: str, lo: int, a: int, b: int, words: list[str], typed: str, cuts: int, seed: int, out: list) -> None:
        """A phrase before a number, and it without its first word, which may belong to the words before."""
        whole = form(" ".join(words))
        out.append(Candidate("address", a, b, (typed or "phrase " + whole,), shape=whole, cue=self._left(m, lo, a), seed=seed, group=a))
        if cuts and len(words) > 1:
            rest = form(" ".join(words[1:]))
            a2 = a + len(words[0])
            a2 += len(m[a2:b]) - len(m[a2:b].lstrip())
            out.append(Candidate("address", a2, b, (typed or "phrase " + rest, "cut " + whole), shape=rest, cue=self._left(m, lo, a2), seed=seed, group=a, cut=1))

    def _numbers(self, m: str, lo: int, hi: int, out: list, taken: list) -> None:
        labels = None
        for x in _NUMBER.finditer(m, lo, hi):
            a, b = x.span()
            s = x.group()
            if sum(c.isdigit() for c in s) < DIGITS or any(a < t and u < b for u, t in taken):
                continue
            if labels is None:
                labels = self._labels(m, lo, hi)
            label = self._label(labels, a, s)
            script = "к" if _CYRILLIC.search(m, lo, a) else ""  # the same shape may stand for other things in another script
            for i, (a2, b2) in enumerate(self._cuts(m, a, b)):
                t = shape(m[a2:b2]) + script
                out.append(self._number(a2, b2, t, label, a, min(i, 1)))
                if "Z" in t and (u := _MISREAD.sub("9", m[a2:b2])) != m[a2:b2]:
                    out.append(self._number(a2, b2, shape(u) + script, label, a, 1))

    @staticmethod
    def _number(a: int, b: int, term: str, label: str, group: int, cut: int) -> Candidate:
        return Candidate("number", a, b, ("label " + label if label else "shape " + term,), "shape " + term, label, group=group, cut=cut)

    @staticmethod
    def _labels(m: str, lo: int, hi: int) -> tuple[list, list, list]:
        """Ends of the label words of a cue, their classes, and the ends of its sentences."""
        low = m[lo:hi].lower()
        if len(low) != hi - lo:
            low = m[lo:hi]
        found = [(lo + x.end(), x.lastgroup) for x in _LABEL_WORD.finditer(low)]
        return [f[0] for f in found], [f[1] for f in found], [lo + x.end() for x in _STOP.finditer(low)]

    @staticmethod
    def _label(labels: tuple[list, list, list], a: int, found: str) -> str:
        """What the nearest label word before a number in its sentence says it is."""
        ends, classes, stops = labels
        i, j = bisect_right(ends, a) - 1, bisect_right(stops, a) - 1
        if i >= 0 and (j < 0 or ends[i] > stops[j]):
            return classes[i]
        return "phone" if found.startswith(("+", "(+")) else ""

    @staticmethod
    def _left(m: str, lo: int, a: int) -> str:
        """The two words before, of the same sentence, as forms."""
        at = a
        for _ in range(2):
            while at > lo and m[at - 1] in " \x1f":
                at -= 1
            at = max(m.rfind(" ", lo, at), m.rfind("\x1f", lo, at), lo - 1) + 1
        s = m[at:a]
        s = s[s.rfind(". ") + 1 :]
        return " ".join(form(x.strip(".,:;!?¡¿-")) for x in s.replace("\x1f", " ").split())

    @staticmethod
    def _cuts(m: str, a: int, b: int) -> list[tuple[int, int]]:
        """The number, and it without its last or first parts: another number may follow or precede it."""
        out = [(a, b)]
        s = m[a:b]
        gaps = [x.span() for x in re.finditer(r" +", s)]
        for g in reversed(gaps):
            if sum(c.isdigit() for c in s[: g[0]]) >= DIGITS:
                out.append((a, a + g[0]))
        for g in gaps:
            if sum(c.isdigit() for c in s[g[1] :]) >= DIGITS:
                out.append((a + g[1], b))
        return out

    def _names(self, m: str, out: list) -> None:
        """Neighbouring capitalised words in either order, initials included, and digits told in words."""
        prev: list[tuple[re.Match, str, str]] = []
        spelled: list[re.Match] = []
        name = self._name
        for x in _TOKEN.finditer(m):
            self.words += 1
            tok = x.group()
            f, role = name(tok)
            if role == "d":
                if spelled and m[spelled[-1].end() : x.start()].strip(" ,-"):
                    spelled = self._spelled(m, spelled, out)
                spelled.append(x)
            elif spelled:
                spelled = self._spelled(m, spelled, out)
            if f == "-":
                bare = tok.strip("-–—*_~#♪¿¡`")
                if not (len(bare) <= 2 and bare[:1].isupper() and (bare[1:] == "." or len(bare) == 1)) and not ("-" in tok and len(tok) > 3 and tok[0].isupper()):
                    prev = []
                    continue
            if prev:
                gap = m[prev[-1][0].end() : x.start()]
                dotted = prev[-1][0].group().endswith(".") and len(prev[-1][0].group().strip("¿¡-")) > 2
                if dotted or not (gap.strip(" ") in ("", ",") and "\x1e" not in gap and len(gap) <= 4 and gap):
                    prev = []
                elif gap.strip(" ") == ",":
                    self._comma(prev[-1], (x, f, role), out)
                    prev = []
            if prev:
                self._pair(prev, (x, f, role), out)
            prev.append((x, f, role))
            if len(prev) > 3:
                prev.pop(0)
        if spelled:
            self._spelled(m, spelled, out)

    def _spelled(self, m: str, run: list[re.Match], out: list) -> list:
        """A number told in words."""
        if len(run) >= SPELLED:
            a = run[0].start()
            b = run[-1].start() + len(run[-1].group().rstrip(".'’-–"))
            lo = m.rfind("\x1e", 0, a) + 1
            label = self._label(self._labels(m, lo, a), a, "")
            out.append(self._number(a, b, f"words {len(run)}", label, a, 0))
        return []

    def _parts(self, token: str) -> list[tuple[str, bool]]:
        """The parts of a family name that may be double, and whether each is listed as one."""
        parts = [p for p in re.split(r"[-‐]", token.strip(".'’*_~#♪¿¡`")) if p]
        forms = [form(p.replace("’", "'")) for p in parts if p[:1].isupper() or not p[:1].islower()]
        if len(forms) != len(parts):
            return []
        return [(f, "f" in self.listed.get(f, "")) for f in forms]

    @staticmethod
    def _person(a: int, b: int, given: tuple[str, str] | None, family: list[tuple[str, bool]], out: list, counts: bool = False) -> None:
        """A name: each part is a term in its role. ``counts``: a place for the statistics."""
        terms = ["g " + given[0]] if given else []
        terms += ["f " + f for f, _ in family]
        seed = 1 if given and "g" in given[1] and family and all(x[1] for x in family) else 0
        shape_ = "|".join(f for f, _ in family) if counts else ""
        out.append(Candidate("name", a, b, tuple(terms), shape_, given[0] if given and counts else "", seed))

    def _pair(self, prev: list, cur: tuple, out: list) -> None:
        (x1, f1, r1), (x2, f2, r2) = prev[-1], cur
        t1, t2 = x1.group(), x2.group()
        lead = _lead(t1)
        a, end = x1.start() + lead, x2.start() + len(t2.rstrip(".'’*_~#♪`-"))
        i1, i2 = _INITIAL.match(t1[lead:]), _INITIAL.match(t2)
        before = prev[-2] if len(prev) >= 2 and prev[-2][1] != "-" and not _INITIAL.match(prev[-2][0].group()) else None
        a0 = before[0].start() + _lead(before[0].group()) if before else 0
        if i2 and not i1:
            if t2.endswith(".") and len(t2) == 2 and f1 != "-":
                self._person(a, x2.end(), (f1, r1), [], out)
        elif i1 and not i2:
            fam2 = self._parts(t2)
            if t1.endswith(".") and fam2:
                self._person(a, end, None, fam2, out)
                if before:  # a middle initial
                    self._person(a0, end, before[1:], fam2, out, True)
        elif not i1:
            fam1, fam2 = self._parts(t1), self._parts(t2)
            if f1 != "-" and fam2:
                if before and fam1 and f1 != "-":  # given name and two family names
                    self._person(a0, end, before[1:], fam1 + fam2, out)
                self._person(a, end, (f1, r1), fam2, out, True)
            if f2 != "-" and fam1:
                self._person(a, end, (f2, r2), fam1, out)

    def _comma(self, one: tuple, two: tuple, out: list) -> None:
        (x1, f1, r1), (x2, f2, r2) = one, two
        t1, t2 = x1.group(), x2.group()
        fam1 = self._parts(t1)
        if not fam1 or t1.endswith("."):
            return
        a = x1.start() + _lead(t1)
        if _INITIAL.match(t2) and t2.endswith("."):
            self._person(a, x2.end(), None, fam1, out)
        elif f2 != "-":
            self._person(a, x2.start() + len(t2.rstrip(".'’*_~#♪`-")), (f2, r2), fam1, out)


def _found(raw: str, c: Candidate, sub: bool) -> str:
    return re.sub(r"[ \t]*(?:\r\n|\r|\n)[ \t]*" if not sub else r"[ \t]*(?:\r\n|\r|\n|\|)[ \t]*", " ", raw[c.ra : c.rb])


def _is_sub(raw: str, cue_format: str | None) -> bool:
    return cue_format == "sub" or raw[:2].lstrip("﻿")[:1] == "{"


def _listed_rows(names: DataFrame) -> list:
    """The name list, which every task holds; a longer one than ``MAX_LISTED`` is refused."""
    rows = names.where("name is not null").select("name", "name_role").distinct().limit(MAX_LISTED + 1).collect()
    if len(rows) > MAX_LISTED:
        raise ValueError(f"the name list has more than {MAX_LISTED} names; learn the rest from the documents")
    return rows


def _listed(rows: list) -> tuple[dict[str, str], frozenset[str]]:
    listed: dict[str, str] = {}
    for r in rows:
        f = form(r.name.strip())
        listed[f] = "".join(sorted(set(listed.get(f, "")) | {(r.name_role or "?")[0]}))
    return listed, frozenset(n for r in rows if len(n := _unaccented(r.name)) > 3)


_CANDIDATE = "doc_id {}, text_hash long, kind string, found string, a long, b long, t1 string, t2 string, t3 string, shape string, cue string, seed int, grp long, cut int"
_COLUMNS = [c.split()[0] for c in _CANDIDATE.split(", ")]


def _terms(c: Candidate) -> tuple:
    """Three terms at most: of a name of more than two family parts the further ones are one."""
    t = c.terms
    if len(t) > 3:
        t = (t[0], t[1], "f " + "+".join(x[2:] for x in t[2:]))
    return t + (None,) * (3 - len(t))


def candidates(docs: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text", cue_format: str | None = "cue_format") -> DataFrame:
    """One row per candidate, see :class:`Candidate`, and rows of kind ``words`` with numbers of words. One pass, no shuffle."""
    ship(docs.sparkSession)
    listed, spelled = _listed(_listed_rows(names))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(listed, spelled)
        for b in batches:
            rows = []
            for d, t, f, h in zip(b["doc_id"], b["text"], b["fmt"], b["h"]):
                sub = _is_sub(t, f)
                for c in finder.find(t, f):
                    rows.append((d, h, c.kind, _found(t, c, sub), c.ra, c.rb, *_terms(c), c.shape, c.cue, c.seed, c.group, c.cut))
            rows.append((None, 0, "words", "", finder.words, 0, None, None, None, "", "", 0, 0, 0))
            finder.words = 0
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"seed": "int32", "cut": "int32"})

    return _texts(docs, doc_id, text, cue_format).select("*", F.xxhash64("text").alias("h")).mapInPandas(scan, _CANDIDATE.format(dict(docs.dtypes)[doc_id]))


def _texts(docs: DataFrame, doc_id: str, text: str, cue_format: str | None) -> DataFrame:
    fmt = F.col(cue_format) if cue_format else F.lit(None).cast("string")
    return docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), fmt.alias("fmt"))


# ---------------------------------------------------------------- disclosure


def disclosures(cand: DataFrame, names: DataFrame) -> DataFrame:
    """``term, kind, disclosure``: for each term the share of an entity's information content that it gives away (see the module).

    Of several entities the one it tells most of. Sums over the whole corpus; one row of totals reaches the driver.
    """
    whole = cand.where("cut = 0")
    n = whole.where("kind = 'number'")
    pairs = whole.where("kind = 'name' and shape <> ''")
    tot = cand.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "words", F.col("a"))), F.lit(0)).alias("words"),
        *[F.count_if((F.col("kind") == "number") & (F.col("cut") == 0) & (F.col("cue") == k)).alias(k) for k in ("phone", "id")],
        *[F.count_if((F.col("kind") == k) & (F.col("cut") == 0) & (F.col("seed") == 1)).alias(k) for k in ("email", "address", "name")],
    ).first()
    ic = {k: math.log((tot[k] + 0.5) / (tot.words + _WORDS + tot[k])) for k in KINDS}

    def share(hits: Column, places: Column, kind: str) -> Column:
        return 1 - F.log((hits + _HITS) / (places + _PLACES)) / ic[kind]

    # digit shapes by the labels they stand behind; a label of an entity is the entity
    per = n.groupBy("shape").agg(F.count("*").alias("n"), *[F.count_if(F.col("cue") == k).alias(k) for k in ("phone", "id")])
    two = per.select(F.col("shape").alias("term"), share(F.col("phone"), F.col("n"), "phone").alias("p"), share(F.col("id"), F.col("n"), "id").alias("i"))
    shapes = two.select("term", F.when(F.col("p") >= F.col("i"), "phone").otherwise("id").alias("kind"), F.greatest("p", "i").alias("disclosure"))
    things = n.where("cue = 'thing'").agg(F.count("*").alias("n")).select(F.lit("label thing").alias("term"), F.lit("id").alias("kind"), share(F.lit(0), F.col("n"), "id").alias("disclosure"))
    labels = cand.sparkSession.createDataFrame([("label phone", "phone", 1.0), ("label id", "id", 1.0)], "term string, kind string, disclosure double")
    # skeletons of mail by the names and labels they stand with
    mails = whole.where("kind = 'email'").groupBy(F.col("t1").alias("term")).agg(F.count("*").alias("n"), F.sum("seed").alias("k")).select(
        "term", F.lit("email").alias("kind"), share(F.col("k"), F.col("n"), "email").alias("disclosure"))
    # frames by the seed street words behind them, then street words and phrases by the frames they stand in
    places = whole.where("kind = 'address'")
    frames = places.groupBy("cue").agg(F.count("*").alias("n"), F.sum("seed").alias("k")).select("cue", share(F.col("k"), F.col("n"), "address").alias("framed"))
    streets = places.join(frames, "cue").groupBy(F.col("t1").alias("term")).agg(
        F.count("*").alias("n"), F.count_if(F.col("framed") >= DISCLOSURE).alias("k")).select("term", F.lit("address").alias("kind"), share(F.col("k"), F.col("n"), "address").alias("disclosure"))
    # a first word is none of the address if the rest stands alone often enough
    alone = places.groupBy(F.col("shape").alias("rest")).agg(F.count("*").alias("alone"))
    longer = cand.where("kind = 'address' and cut = 1").groupBy(F.col("t2").alias("term"), F.col("shape").alias("rest")).agg(F.count("*").alias("n"))
    cuts = longer.join(alone, "rest", "left").groupBy("term").agg(F.sum("n").alias("n"), F.coalesce(F.max("alone"), F.lit(0)).alias("k")).select(
        "term", F.lit("address").alias("kind"), share(F.col("k"), F.col("n") + F.col("k"), "address").alias("disclosure"))
    # parts of names by their different partners
    listed = _listed_frame(names)
    parts = pairs.select(F.col("cue").alias("g"), F.explode(F.split("shape", r"\|")).alias("f")).distinct()
    g_list, f_list = (listed.where(F.col("role") == r).select(F.col("part").alias(r), F.lit(1).alias(f"{r}_listed")) for r in ("g", "f"))
    marked = parts.join(F.broadcast(g_list), "g", "left").join(F.broadcast(f_list), "f", "left")  # at most MAX_LISTED names
    roles = []
    for own, other, own_list in (("g", "f", g_list), ("f", "g", f_list)):
        seen = marked.groupBy(F.col(own).alias("w")).agg(F.count("*").alias("n"), F.count(f"{other}_listed").alias("k"), F.max(f"{own}_listed").alias("listed"))
        never = own_list.select(F.col(own).alias("w"), F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(1).alias("listed"))
        c = seen.unionByName(never).groupBy("w").agg(F.max("n").alias("n"), F.max("k").alias("k"), F.max("listed").alias("listed"))
        bonus = F.coalesce("listed", F.lit(0)) * LISTED
        # one partner may be chance, so it never counts
        less = lambda x: F.greatest(x - 1, F.lit(0)) + bonus
        roles.append(c.select(F.concat(F.lit(own + " "), "w").alias("term"), F.lit("name").alias("kind"), share(less(F.col("k")), less(F.col("n")), "name").alias("disclosure")))
    out = shapes
    for part in (things, labels, mails, streets, cuts, *roles):
        out = out.unionByName(part)
    return out.where(~F.col("term").isin([f"g {t}" for t in sorted(_TITLES)]))


def _listed_frame(names: DataFrame) -> DataFrame:
    rows = {(form(r.name.strip()), (r.name_role or "?")[0]) for r in _listed_rows(names)}
    return names.sparkSession.createDataFrame(sorted(rows) or [("", "")], "part string, role string")


def _spans(cand: DataFrame, accepted: DataFrame) -> DataFrame:
    """``doc_id, text_hash, pii_type, found, a, b``: the candidates all of whose terms are accepted, one reading of each piece.

    Of the cuts of a number the longest whose shape discloses, else of a labelled one the whole; of a phrase the shorter reading,
    which is only accepted if the first word is none of it; a name inside a longer one is left out where it lies inside it.
    """
    j = cand.where("kind <> 'words'")
    for t in ("t1", "t2", "t3"):
        j = j.join(accepted.select(F.col("term").alias(t), F.col("kind").alias(f"{t}_kind")), t, "left")
    j = j.where("t1_kind is not null and (t2 is null or t2_kind is not null) and (t3 is null or t3_kind is not null)")
    shapes = accepted.where("term like 'shape %'").select(F.col("term").alias("shape"), F.lit(1).alias("discloses"))
    j = j.join(shapes, "shape", "left").withColumn("pii_type", F.col("t1_kind"))
    piece = F.struct("found", "a", "b", "pii_type").alias("piece")
    order = F.struct(F.coalesce("discloses", F.lit(0)), F.when(F.col("kind") == "address", F.col("a")).otherwise(F.col("b") - F.col("a")), -F.col("a"))
    one = j.where("kind in ('number', 'address')").groupBy("doc_id", "text_hash", "kind", "grp").agg(F.max_by(piece, order).alias("piece")).select("doc_id", "text_hash", "piece.*")
    rest = j.where("kind = 'email'").select("doc_id", "text_hash", "found", "a", "b", "pii_type")
    name = j.where("kind = 'name'").select("doc_id", "text_hash", "found", "a", "b", "pii_type").distinct()
    within = Window.partitionBy("doc_id", "text_hash")
    outer = name.withColumn("all", F.collect_list(F.struct("a", "b")).over(within)).where(
        ~F.exists("all", lambda o: (o.a <= F.col("a")) & (o.b >= F.col("b")) & (o.b - o.a > F.col("b") - F.col("a")))).drop("all")
    return one.unionByName(rest).unionByName(outer)


def found_pieces(docs: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text", cue_format: str | None = "cue_format", threshold: float = DISCLOSURE) -> DataFrame:
    """``doc_id, pii_type, found``: each distinct piece of personal data of a document.

    Null and empty texts hold none; rows that repeat a document's id are one document; an empty name list leaves names out.
    """
    cand = materialize(candidates(docs, names, doc_id, text, cue_format))
    accepted = materialize(disclosures(cand, names).where(F.col("disclosure") >= F.lit(float(threshold))).select("term", "kind"))
    return _spans(cand, accepted).select("doc_id", "pii_type", "found").distinct()


# ---------------------------------------------------------------- generalisation


def decided(cands: list[Candidate], accepted: dict[str, str]) -> list[tuple[int, int, str]]:
    """Spans and kinds of the candidates of one text that are protected: as :func:`_spans`, for a text at hand."""
    best: dict[tuple[str, int], tuple] = {}
    out, names = [], set()
    for c in cands:
        terms = [t for t in _terms(c) if t is not None]
        if not all(t in accepted for t in terms):
            continue
        kind = accepted[terms[0]]
        if c.kind in ("number", "address"):
            order = (int(c.shape in accepted), c.ra if c.kind == "address" else c.rb - c.ra, -c.ra)
            key = (c.kind, c.group)
            if key not in best or order > best[key][0]:
                best[key] = (order, (c.ra, c.rb, kind))
        elif c.kind == "name":
            names.add((c.ra, c.rb, kind))
        else:
            out.append((c.ra, c.rb, kind))
    open_to, longest = -1, []
    for a, b, kind in sorted(names, key=lambda x: (x[0], -x[1])):
        if b > open_to:
            longest.append((a, b, kind))
            open_to = b
    return out + [v[1] for v in best.values()] + longest


def replaced(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, int]:
    """The text with each span as a typed placeholder, and how many there are; spans that overlap are one, of the kind of the longer."""
    merged: list[list] = []
    for a, b, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if merged and a < merged[-1][1]:
            if b - a > merged[-1][3]:
                merged[-1][2:] = [kind, b - a]
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind, b - a])
    out, last = [], 0
    for a, b, kind, _ in merged:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:], len(merged)


def redact(docs: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text", cue_format: str | None = "cue_format", threshold: float = DISCLOSURE) -> DataFrame:
    """``doc_id, text, n_pieces``: all documents, each protected place as ``[NAME]``, ``[EMAIL]``, ``[PHONE]``, ``[ID]`` or ``[ADDRESS]``.

    A first pass learns the terms, a second applies them in place, so texts are not shuffled. The accepted terms, of which
    there are few, go to the tasks; where there are more than ``MAX_TERMS`` the pieces are joined to the documents instead.
    Null and empty texts and documents without personal data come out unchanged, repeated rows each.
    """
    cand = materialize(candidates(docs, names, doc_id, text, cue_format))
    accepted = materialize(disclosures(cand, names).where(F.col("disclosure") >= F.lit(float(threshold))).select("term", "kind"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(cue_format) if cue_format else F.lit(None).cast("string")).alias("fmt"))
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, text string, n_pieces int"
    rows = accepted.limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        return _redact_by_join(d, _spans(cand, accepted))
    known = {r.term: r.kind for r in rows}
    release(cand)
    release(accepted)
    ship(docs.sparkSession)
    listed, spelled = _listed(_listed_rows(names))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(listed, spelled)
        for b in batches:
            new = [replaced(t, decided(finder.find(t, f), known)) if t else (t, 0) for t, f in zip(b["text"], b["fmt"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [x[0] for x in new], "n_pieces": [x[1] for x in new]}).astype({"n_pieces": "int32"})

    return d.mapInPandas(apply, schema)


def _redact_by_join(d: DataFrame, spans: DataFrame) -> DataFrame:
    per = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b", "pii_type")).alias("pieces"))

    @F.pandas_udf("text string, n_pieces int")
    def put(texts: pd.Series, pieces: pd.Series) -> pd.DataFrame:
        new = [replaced(t, [(p["a"], p["b"], p["pii_type"]) for p in ps]) if t and ps is not None else (t, 0) for t, ps in zip(texts, pieces)]
        return pd.DataFrame(new, columns=["text", "n_pieces"])

    j = d.withColumn("text_hash", F.xxhash64("text")).join(per, ["doc_id", "text_hash"], "left")
    return j.select("doc_id", put("text", "pieces").alias("r")).select("doc_id", "r.text", "r.n_pieces")
