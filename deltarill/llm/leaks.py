"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over words.

The patterns are all passages of ``m`` successive words of the evaluation items; the alphabet is words, brought to one form
whatever their case, punctuation, recognition errors and encoding. A block is ``BLOCK`` words. The shift table says how far the
search may jump when a block ends a window: past the block if no pattern has it, less by its place otherwise; a word of no item
lets it jump past the word. Where the shift is 0, the suffix hash gives the passages that end with the block, the prefix hash
those of them that also begin as the window does, and only these are compared word by word. A block of several words is rare
however many items there are, so a document costs about the same with few items and with many.

Documents are read where they lie (no shuffle), whole and once. Items are packed into tables of at most ``ITEM_WORDS`` words,
which are built one at a time and sent to the executors as files; a task holds one table at a time and goes over its documents
with each. A word is what stands between blanks: text without blanks has no passages.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltarill.session import ship

#: successive words that make a leak
MIN_WORDS = 12
#: words of a block
BLOCK = 4
#: words of evaluation text in one table; bounds what a task holds
ITEM_WORDS = 500_000
#: signs of text that a task keeps while it changes tables, where there is more than one
KEPT_SIGNS = 64_000_000
#: words whose form a task remembers
_REMEMBERED = 400_000

# fixed values: how recognition errors and lost signs are brought to one form. Signs that are taken for each other share one
# form, and a sign that is taken for two has the form of the two.
_SAME_FORM = {
    "i": "l", "1": "l", "!": "l", "|": "l", "t": "l", "j": "l", "7": "l", "u": "ll", "h": "ll", "d": "cl", "m": "rn", "w": "vv",
    "e": "c", "a": "o", "0": "o", "5": "s", "$": "s", "q": "g", "9": "g", "6": "b", "8": "b", "3": "b", "?": "~", "�": "~",
}
# fixed values: Latin letters and digits that stand for Cyrillic ones
_CYRILLIC_FORM = str.maketrans("aeopcxykmhtb03641", "аеорсхукмнтвозбчл")
_TIME = re.compile(r"-->|^\s*\d+\s*$|^\s*(?:WEBVTT|NOTE|STYLE)\b")
# the sign \x1e stands between cues, which markup does not cross
_MARKUP = re.compile(r"<[^<>\n\x1e]*>|\{[^{}\n\x1e]*\}|\[[^\[\]\x1e]*\]|\([^()\x1e]*\)|♪[^♪\n\x1e]*♪|\*[^*\n\x1e]+\*|^[ \t]*[-–]?[ \t]*[?�] [^\n]*[?�][ \t]*$", re.M)
_LABEL = re.compile(r"^[ \t]*(?:[-–—][ \t]*)?(?:[A-ZÀ-ÞА-ЯЁ][A-ZÀ-ÞА-ЯЁ .'#0-9-]{1,30}|[A-ZÀ-ÞА-ЯЁ][a-zà-ÿа-яё]+(?: #?\d+)?):(?=\s)", re.M)
_HIGH = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 192))
_UTF8_RUN = re.compile("(?:[Â-ô][" + re.escape(_HIGH) + "\u0080-¿]{1,3})+")
_EDGE = "\"“”„«»‹›¿¡.,;:…()[]{}-–—~*#_♪"
_QUOTES = str.maketrans("’‘´`", "''''")


def _sloppy_bytes(s: str) -> bytes:
    out = bytearray()
    for ch in s:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 255:
                raise
            out.append(ord(ch))
    return bytes(out)


def _undo(run: re.Match) -> str:
    try:
        return _sloppy_bytes(run.group()).decode("utf-8")
    except (UnicodeError, ValueError):
        return run.group()


def readable(text: str) -> str:
    """Entities as their signs, composed letters, and UTF-8 that was read as a one-byte encoding (once or twice) as itself."""
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if text.isascii():
        return text
    for _ in range(3):
        fixed = _UTF8_RUN.sub(_undo, text)
        if fixed == text:
            break
        text = fixed
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def spoken(text: str, cue_format: str | None = None) -> str:
    """The words of the cues: without numbers, times, markup, sound descriptions and speaker labels."""
    text = readable(text).replace("\r\n", "\n").replace("\r", "\n").replace("﻿", "")
    if cue_format == "sub" or (cue_format is None and text[:1] == "{"):
        text = text.replace("|", "\n")
    kept = "\n".join("\x1e" if _TIME.search(line) else line for line in text.split("\n")).replace("\n\n", "\n\x1e\n")
    return _LABEL.sub(" ", _MARKUP.sub(" ", kept))


def form(word: str) -> str:
    """The one form of a word that is free of punctuation around it; a sign that is not ASCII has the form of a lost one, as has ``ss`` for its ``ß``."""
    low = word.lower()
    if low.isascii():
        return "".join([_SAME_FORM.get(c, c) for c in low]).replace("ss", "~")
    if any("Ѐ" <= c <= "ӿ" for c in low):
        return low.translate(_CYRILLIC_FORM).replace("ё", "е")
    return "".join([_SAME_FORM.get(c, c if c.isascii() else "~") for c in low]).replace("ss", "~")


def _readings(token: str) -> Iterator[str]:
    """Forms a token may stand for: signs at its end are punctuation, or letters that were misread; letters of another code page."""
    core = token.translate(_QUOTES).strip(_EDGE).strip("'")
    bare = core.rstrip("!?").strip(_EDGE).strip("'")
    yield form(bare)
    if bare != core:
        yield form(core)
        yield form(core[: len(bare) + 1])
    if not token.isascii():
        for wrong, right in (("cp1252", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866")):
            try:
                raw = _sloppy_bytes(core) if wrong == "cp1252" else core.encode(wrong)
                yield form(raw.decode(right).strip(_EDGE).rstrip("!?"))
            except (UnicodeError, ValueError):
                continue


def item_words(text: str) -> list[str]:
    """The forms of an item's words, in order."""
    out = []
    for token in readable(text).split():
        core = token.translate(_QUOTES).strip(_EDGE).rstrip("!?").strip(_EDGE).strip("'")
        if core:
            out.append(form(core))
    return out


class Tables:
    """Shift table, suffix and prefix hash, and word numbers of one set of items."""

    def __init__(self, items: Iterable[tuple[object, list[str]]], m: int = MIN_WORDS):
        self.m = m
        self.block = max(1, min(BLOCK, m // 2))
        self.number: dict[str, int] = {}
        self.shift: dict[tuple, int] = {}
        # by last and first block, the passages there are, each with the items that hold it
        self.ends: dict[tuple, dict[tuple, dict[tuple, list]]] = {}
        b = self.block
        for item, words in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
            if len(ids) < m:
                continue
            for end in range(b, len(ids) + 1):
                at, jump = ids[end - b : end], max(0, m - end)  # a passage ends here, or the first one does later
                if jump < self.shift.get(at, m):
                    self.shift[at] = jump
                if not jump:
                    w = ids[end - m : end]
                    held = self.ends.setdefault(at, {}).setdefault(w[:b], {}).setdefault(w, [])
                    if not held or held[-1] != item:
                        held.append(item)
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def ids(self, text: str) -> list[int]:
        """Word numbers of a text, 0 for words of no item; tokens of punctuation only are none."""
        out, known = [], self.known
        for token in text.split():
            i = known.get(token)
            if i is None:
                i = self._read(token)
            if i >= 0:
                out.append(i)
        return out

    def _read(self, token: str) -> int:
        found = -1
        for f in _readings(token):
            if f:
                found = self.number.get(f, 0)
                if found:
                    break
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        self.known[token] = found
        return found

    def search(self, ids: list[int]) -> set:
        """The items that have a passage of ``m`` words in common with the text."""
        m, b, shift, ends = self.m, self.block, self.shift, self.ends
        most = m - b + 1
        found: set = set()
        pos, n = m, len(ids)  # the window ends before pos
        while pos <= n:
            if not ids[pos - 1]:
                pos += m
                continue
            block = tuple(ids[pos - b : pos])
            jump = shift.get(block, most)
            if jump:
                pos += jump
                continue
            window = tuple(ids[pos - m : pos])
            by_prefix = ends[block].get(window[:b])
            if by_prefix:
                found.update(by_prefix.get(window, ()))
            pos += 1
        return found


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, list[str]]]]:
    """Items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for r in items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = item_words(r.t)
        block.append((r.i, words))
        size += len(words)
        if size >= ITEM_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", cue_format: str | None = "cue_format", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id``: each document and item with a passage of at least ``min_words`` successive words in common, once per row.

    Null and empty texts hold nothing; an item of fewer words cannot be found; an empty table gives no row. Items with the same
    text are all reported. Two rows of the same document id each report theirs.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    ship(docs.sparkSession)
    out_schema = f"doc_id {dict(docs.dtypes)[doc_id]}, item_id {dict(items.dtypes)[item_id]}"
    cols = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(cue_format) if cue_format else F.lit(None).cast("string")).alias("fmt")]
    source = docs.where(F.col(text).isNotNull()).select(*cols)
    # each table has at most ITEM_WORDS words; the driver keeps their files, not the tables
    tables = [docs.sparkSession.sparkContext.broadcast(Tables(block, min_words)) for block in _blocks(items, item_id, item_text)]
    if not tables:
        return docs.sparkSession.createDataFrame([], out_schema)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[object, str]] = []

        def searched() -> pd.DataFrame:
            hits = []
            for t in tables:
                table = t.value
                hits += [(d, i) for d, words in held for i in sorted(table.search(table.ids(words)), key=str)]
                if len(tables) > 1:  # one table in memory at a time; the file stays
                    del table
                    t.__dict__.pop("_value", None)
            held.clear()
            return pd.DataFrame({"doc_id": [h[0] for h in hits], "item_id": [h[1] for h in hits]})

        size = 0
        for b in batches:
            for d, t, f in zip(b["doc_id"], b["text"], b["fmt"]):
                held.append((d, spoken(t, f)))
                size += len(t)
            if len(tables) == 1 or size >= KEPT_SIGNS:
                yield searched()
                size = 0
        if held:
            yield searched()

    return source.mapInPandas(scan, out_schema)


def leaked_items(found: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """``item_id, n_docs``: in how many documents each item was found, 0 included."""
    n = found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    return items.select(F.col(item_id).alias("item_id")).join(n, "item_id", "left").fillna(0, ["n_docs"])
