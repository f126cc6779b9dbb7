"""Text that was decoded with the wrong character encoding: found, and restored where the bytes are still there.

The characters of a text are mapped back to the bytes of a legacy code page.  Over those bytes runs an automaton of the
byte structure of UTF-8 (or of Shift_JIS, EUC-JP), compiled to a regular expression over the page's own characters; it
finds the maximal well-formed multibyte spans, and only those spans are decoded.  A span counts only if what it decodes
to is plausible text: assigned characters, letters of one script, more than a chance pair of them.  Spans are tried over several pages, again for doubly wrong text, and through named character
references.  Cyrillic read with another Cyrillic page has no multibyte structure: there a run of letters is decoded with
the page under which its letters have the frequencies of Russian.  U+FFFD marks text whose bytes are lost.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that text is wrongly read with.
PAGES = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_15")
_CYRILLIC_PAGES = {"cp1251", "koi8_r", "cp866"}
#: (read with, written in)
SWAPS = (("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("koi8_r", "cp866"), ("cp866", "cp1251"), ("cp866", "koi8_r"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"))
#: Frequency of the Russian letters, in 1/10000.
RUSSIAN = {
    "о": 1097, "е": 845, "а": 801, "и": 735, "н": 670, "т": 626, "с": 547, "р": 473, "в": 454, "л": 440, "к": 349, "м": 321, "д": 298, "п": 281, "у": 262, "я": 201,
    "ы": 190, "ь": 174, "г": 170, "з": 165, "б": 159, "ч": 144, "й": 121, "х": 97, "ж": 94, "ш": 73, "ю": 64, "ц": 48, "щ": 36, "э": 32, "ф": 26, "ъ": 4, "ё": 4,
}


@lru_cache(None)
def page(name: str) -> dict[str, int]:
    """Character -> byte of the upper half of a code page; cp1252 and cp1251 also with C1 controls."""
    table: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            continue
        table.setdefault(c, b)
    if name in ("cp1252", "cp1251"):
        given = set(table.values())
        for b in range(0x80, 0xA0):
            if name == "cp1252" or b not in given:
                table.setdefault(chr(b), b)
    return table


def _cls(name: str, *ranges: tuple[int, int]) -> str:
    chars = [c for c, b in page(name).items() if any(lo <= b <= hi for lo, hi in ranges)]
    chars += [chr(b) for lo, hi in ranges for b in range(lo, min(hi, 0x7F) + 1)]
    return "[" + "".join(map(re.escape, chars)) + "]" if chars else r"(?!)"


@lru_cache(None)
def automaton(name: str, written: str) -> re.Pattern:
    """Maximal spans of page ``name`` that are well-formed multibyte text of ``written``."""
    c = lambda *r: _cls(name, *r)
    if written == "utf-8":
        t = c((0x80, 0xBF))
        forms = [c((0xC2, 0xDF)) + t, c((0xE0, 0xE0)) + c((0xA0, 0xBF)) + t, c((0xE1, 0xEC), (0xEE, 0xEF)) + t + t, c((0xED, 0xED)) + c((0x80, 0x9F)) + t, c((0xF0, 0xF0)) + c((0x90, 0xBF)) + t + t, c((0xF1, 0xF3)) + t + t + t, c((0xF4, 0xF4)) + c((0x80, 0x8F)) + t + t]
    elif written == "shift_jis":
        forms = [c((0x81, 0x9F), (0xE0, 0xEA)) + c((0x40, 0x7E), (0x80, 0xFC))]
    else:  # euc_jp
        forms = [c((0xA1, 0xF4)) + c((0xA1, 0xFE))]
    return re.compile("(?:" + "|".join(forms) + ")+")


def to_bytes(s: str, name: str) -> bytes:
    table = page(name)
    return bytes(table.get(ch, ord(ch)) for ch in s)


_LATIN, _PUNCT, _DRAWN, _CYR, _EAST = range(5)
#: First words of the names of characters that are no letters of a living script.
_RARE = {"?", "COPTIC", "COMBINING", "MODIFIER", "SUPERSCRIPT", "SUBSCRIPT", "ROMAN", "CIRCLED", "PARENTHESIZED", "MATHEMATICAL", "FULLWIDTH", "HALFWIDTH", "VULGAR", "SMALL", "DOUBLE-STRUCK", "SCRIPT", "BLACK-LETTER", "TURNED", "GLAGOLITIC", "RUNIC", "OGHAM"}


@lru_cache(1 << 16)
def _kind(ch: str) -> int | str | None:
    """Class of a plausible character (of a letter of another script: the script), None for any other."""
    o = ord(ch)
    if o in (0x138, 0x149, 0x166, 0x167, 0x17F):  # in no language's plain spelling, often a chance pair
        return None
    if 0xA0 <= o <= 0x17F or 0x1E00 <= o <= 0x1EFF or o in (0x1A0, 0x1A1, 0x1AF, 0x1B0, 0x218, 0x219, 0x21A, 0x21B, 0x2C6, 0x2DC):
        return _LATIN
    if 0x2010 <= o <= 0x203A or o in (0x20AC, 0x2122, 0x2116):
        return _PUNCT
    if 0x2190 <= o <= 0x21FF or 0x2500 <= o <= 0x257F or 0x2600 <= o <= 0x27BF or 0x2200 <= o <= 0x22FF:
        return _DRAWN
    if 0x400 <= o <= 0x45F or o in (0x490, 0x491):
        return _CYR
    if 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xFF01 <= o <= 0xFF9F:
        return _EAST
    if 0x1F300 <= o <= 0x1FAFF or 0xFE00 <= o <= 0xFE0F or o == 0x200D:
        return _PUNCT
    if o >= 0x370 and unicodedata.category(ch)[0] in "LMN":
        script = unicodedata.name(ch, "?").split(" ")[0]
        return script if script not in _RARE else None
    return None


def _scripts(kinds: list) -> dict[str, int]:
    """Letters of each script other than Latin, Cyrillic and East Asian ones."""
    out: dict[str, int] = {}
    for k in kinds:
        if isinstance(k, str):
            out[k] = out.get(k, 0) + 1
    return out


def _decode_deep(s: str, depth: int = 3) -> str | None:
    """UTF-8 spans of s (page cp1252) decoded, and again while the outcome is itself such a span; None if implausible."""
    if s and all(_kind(ch) is not None for ch in s):
        deeper = _again(s, depth)
        return deeper or s
    return _again(s, depth)


def _again(s: str, depth: int) -> str | None:
    if not depth:
        return None
    pat = automaton("cp1252", "utf-8")
    if not pat.search(s):
        return None
    out = pat.sub(lambda m: to_bytes(m.group(), "cp1252").decode("utf-8"), s)
    if all(_kind(ch) is not None for ch in out):
        return _again(out, depth - 1) or out
    return _again(out, depth - 1)


def _spans(text: str, name: str) -> list[tuple[int, int, str]]:
    """Accepted UTF-8 spans of the text under one page: (start, end, decoded)."""
    found = []
    for m in automaton(name, "utf-8").finditer(text):
        # trim implausible characters off the ends, so that one chance neighbour doesn't void a span
        decoded = to_bytes(m.group(), name).decode("utf-8")
        if (d := _decode_deep(decoded)) is not None:
            found.append((m.start(), m.end(), d))
    if not found:
        return []
    kinds = [[_kind(ch) for ch in d] for _, _, d in found]
    cyr, east = sum(k.count(_CYR) for k in kinds), sum(k.count(_EAST) for k in kinds)
    run_cyr, run_east = max(k.count(_CYR) for k in kinds), max(k.count(_EAST) for k in kinds)
    outside = 0
    if name in _CYRILLIC_PAGES:
        taken = set()
        for a, b, _ in found:
            taken.update(range(a, b))
        outside = sum(1 for i, ch in enumerate(text) if _kind(ch) == _CYR and i not in taken)
    kept = []
    others = _scripts([x for k in kinds for x in k])
    main = max(others, key=lambda x: (others[x], x)) if others else None
    starts, stops = {a for a, _, _ in found}, {b for _, b, _ in found}
    for (a, b, d), k in zip(found, kinds, strict=True):
        mine = _scripts(k)
        # letters of another script: of one script in the whole text, more than a chance pair, and not among Cyrillic or East Asian ones
        if mine and (set(mine) != {main} or others[main] < 3 or max(mine.values()) < 2 and others[main] < 6 or _CYR in k or _EAST in k):
            continue
        # one accented letter, or letters of another script, beside a character of the page that is in no span: a one-byte page
        beside = a > 0 and a not in stops and _high_letter(text[a - 1]) or b < len(text) and b not in starts and _high_letter(text[b])
        if beside and (mine or len(d) == 1 and k[0] == _LATIN):
            continue
        if _CYR in k and (cyr < 3 or run_cyr < 2) or _EAST in k and (east < 2 or run_east < 2):
            continue
        if name in _CYRILLIC_PAGES and outside > 3:
            # within Russian text only letters next to Latin letters, or three-byte forms, tell
            beside = (a > 0 and text[a - 1].isascii() and text[a - 1].isalpha()) or (b < len(text) and text[b].isascii() and text[b].isalpha())
            if not (all(x in (_PUNCT, _DRAWN) for x in k) and b - a >= 3 * len(d) or _LATIN in k and beside and d[0].isalpha()):
                continue
        kept.append((a, b, d))
    return kept


def _high_letter(ch: str) -> bool:
    return ch >= "\x80" and ch.isalpha()


_ENTITY = re.compile(r"(?:&[A-Za-z][A-Za-z0-9]{1,8};|[^\x00-\x7f])*&[A-Za-z][A-Za-z0-9]{1,8};(?:&[A-Za-z][A-Za-z0-9]{1,8};|[^\x00-\x7f])*")


def _entities(text: str) -> tuple[str, int]:
    n = 0

    def fix(m: re.Match) -> str:
        nonlocal n
        plain = html.unescape(m.group())
        spans = _spans(plain, "cp1252")
        if not spans:
            return m.group()
        n += len(spans)
        return _replace(plain, spans)

    return _ENTITY.sub(fix, text), n


def _replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, d in spans:
        out += [text[at:a], d]
        at = b
    return "".join([*out, text[at:]])


def _japanese(text: str) -> tuple[str, int, int]:
    """Shift_JIS or EUC-JP read as cp1252: text, spans and the characters they cover."""
    best: tuple[int, str, int] = (0, text, 0)
    for written in ("shift_jis", "euc_jp"):
        spans, short, gain = [], [], 0
        for m in automaton("cp1252", written).finditer(text):
            try:
                d = to_bytes(m.group(), "cp1252").decode("cp932" if written == "shift_jis" else written)
            except UnicodeDecodeError:
                continue
            if not all(_kind(ch) == _EAST for ch in d) or d.encode("cp932" if written == "shift_jis" else written, "replace") != to_bytes(m.group(), "cp1252"):
                continue
            if len(d) >= 3 and sum(0x3040 <= ord(ch) <= 0x30FF for ch in d) >= 0.25 * len(d):
                spans.append((m.start(), m.end(), d))
                gain += len(d)
            else:
                short.append((m.start(), m.end(), d))
        if gain > best[0]:
            best = (gain, _replace(text, sorted(spans + short)), len(spans))
    return best[1], best[2], 2 * (len(text) - len(best[1]))


_LOG = {c: math.log(n / 10000) for c, n in RUSSIAN.items()}
_WORST = math.log(1e-4)
_VOWELS = "аеёиоуыэюя"


def _russian(s: str) -> float:
    """Log-likelihood per non-ASCII character as Russian; unlikely are capitals inside words, a short i behind a
    consonant and signs behind a vowel."""
    total, n, before = 0.0, 0, " "
    for ch in s:
        if ord(ch) >= 0x80:
            low = ch.lower()
            odd = low == "й" and before.isalpha() and before.lower() not in _VOWELS or low in "ъьы" and before.lower() in _VOWELS
            total += _LOG.get(low, _WORST) - (2.0 if ch != low and before.isalpha() else 0.0) - (4.0 if odd else 0.0)
            n += 1
        before = ch
    return total / max(n, 1)


_RUN = re.compile(r"[^\x00-\x7f](?:[^A-Za-z0-9\n.,;:!?]*[^\x00-\x7f])?")
_HIGH = re.compile(r"[^\x00-\x7f]{2,}")
_HIGH5 = re.compile(r"[^\x00-\x7f](?:[^A-Za-z\n]?[^\x00-\x7f]){3}")
_LEADS = re.compile(_cls("cp1252", (0x81, 0x9F)) + "(?:.|\n)" + _cls("cp1252", (0x81, 0x9F), (0xE0, 0xEA)) + "|" + _cls("cp1252", (0xA4, 0xA5)) + "." + _cls("cp1252", (0xA4, 0xA5)))
#: Runs as likely as this are Russian as they stand.
_FINE = -3.5


def _swapped(text: str) -> tuple[str, int]:
    """Runs of single-byte Cyrillic read with another page."""
    best: tuple[float, str, int] = (0.0, text, 0)
    if not _HIGH5.search(text):
        return text, 0
    runs = [(m.start(), m.end(), m.group(), _russian(m.group())) for m in _RUN.finditer(text)]
    runs = [r for r in runs if r[3] < _FINE]
    if not any(len(r[2]) >= 4 for r in runs):
        return text, 0
    for wrong, right in SWAPS:
        table = page(wrong)
        strong, weak, gain = [], [], 0.0
        for a, b, s, was in runs:
            high = [ch for ch in s if ord(ch) >= 0x80]
            if any(ch not in table for ch in high):
                continue
            raw = bytes(table.get(ch, ord(ch)) for ch in s)
            try:
                d = raw.decode(right)
                if d.encode(right) != raw:
                    continue
            except UnicodeError:
                continue
            now, n = _russian(d), len(high)
            letters = sum(1 for ch in d if ch.lower() in RUSSIAN)
            if n >= 5 and letters >= 0.8 * n and now - was > 1.2 and now > -4.0:
                strong.append((a, b, d))
                gain += (now - was) * n
            elif now - was > 0.3 and letters:
                weak.append((a, b, d))
        if strong and gain > best[0]:
            spans = sorted(strong + weak)
            best = (gain, _replace(text, spans), len(spans))
    return best[1], best[2]


def repair(text: str | None) -> tuple[str | None, int, bool]:
    """(restored text, spans decoded, whether lost bytes remain).  Clean, empty and null texts come back as they are."""
    if not text:
        return text, 0, False
    lost = "�" in text
    if text.isascii() and "&" not in text:
        return text, 0, lost
    n = 0
    if "&" in text:
        text, k = _entities(text)
        n += k
    for _ in range(4):
        best: tuple[int, str, list] = (0, "", [])
        # two neighbouring characters at least stand for a multibyte form: a page whose automaton finds nothing in
        # those runs finds nothing in the text
        high = "\n".join(_HIGH.findall(text))
        for name in PAGES if high else ():
            spans = _spans(text, name) if automaton(name, "utf-8").search(high) else []
            gain = sum(b - a for a, b, _ in spans)
            if gain > best[0]:
                best = (gain, name, spans)
        fixed, k, covered = _japanese(text) if _LEADS.search(text) else (text, 0, 0)
        if k and covered > 2 * best[0]:
            text, n = fixed, n + k
            continue
        if not best[0]:
            break
        text, n = _replace(text, best[2]), n + len(best[2])
    text, k = _swapped(text)
    return text, n + k, lost


#: Cheap JVM-side test: only texts with a character that some garbling leaves behind go to Python.
_SUSPECT = r"[^\x00-\x7f]|&[A-Za-z][A-Za-z0-9]{1,8};"


def garbled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``restored`` (text), ``spans`` (decoded spans) and ``lost`` (bytes that can't be had), affected rows only.

    Null, empty and clean texts give no row; a repeated row gives a row each time; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").rlike(_SUSPECT))
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            done = [repair(t) for t in p["_text"]]
            out = pd.DataFrame({"_id": p["_id"].to_numpy(), "restored": [x[0] for x in done], "spans": [x[1] for x in done], "lost": [x[2] for x in done]})
            yield out[(out["spans"] > 0) | out["lost"]]

    return slim.mapInPandas(run, f"_id {kind}, restored string, spans bigint, lost boolean").withColumnRenamed("_id", id_col)
