"""Consistent form, words and bare text of a string.

The character rules are tables derived from the Unicode database at import; the
look-alike letters are the only list written out. ``form``, ``words`` and ``bare``
are plain functions that run inside Arrow batches; ``unify`` (module ``unify``)
computes the same form relationally.
"""

from __future__ import annotations

import re
import unicodedata as ud

#: Letters of other alphabets that are drawn like a Latin letter (fixed values).
LOOKALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТХҺӀԚԜаеорсухѕіјһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ",
        "ABESIJKMHOPCTXHIQWaeopcyxsijhdqw" "ABEZHIKMNOPTYXocj",
        strict=True,
    )
)
#: Signs drawn as the plain hyphen-minus (fixed values).
HYPHENS = "‐‑‒−"
#: Controls that count as blanks beside the Unicode separators (fixed values).
BLANK_CONTROLS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"
#: Marks of TESTDATA.md: full stop, comma, colons, ! ?, quotes, long dash, ellipsis (fixed values).
MARKS = ".,;:!?'\"‘’‚‛“”„‟—…"
#: Compatibility decompositions that only change the shape of a character.
_SHAPES = ("<wide>", "<narrow>", "<small>", "<noBreak>")


def _shape(ch: str) -> str:
    """The plain characters of one character that has no canonical decomposition."""
    if ch in LOOKALIKE:
        return LOOKALIKE[ch]
    if ch in HYPHENS:
        return "-"
    if ch in BLANK_CONTROLS:
        return " "
    kind, dec = ud.category(ch), ud.decomposition(ch)
    if kind in ("Zs", "Zl", "Zp"):
        return " "
    if kind == "Cf" or ch in "͏ᅟᅠ឴឵ㅤﾠ" or kind == "Mn" and ud.name(ch, "").startswith("VARIATION SELECTOR"):
        return ""
    if dec.startswith(_SHAPES) or dec.startswith("<compat>") and "LIGATURE" in ud.name(ch, "") and "LATIN" in ud.name(ch, ""):
        plain = "".join(_shape(c) if c != ch else c for c in "".join(chr(int(x, 16)) for x in dec.split()[1:]))
        return plain
    return ch


def _decompose(ch: str) -> str:
    """Full decomposition of one character after the shape rules."""
    before, now = None, ch
    while now != before:
        before, now = now, ud.normalize("NFD", "".join(map(_shape, ud.normalize("NFD", now))))
    return now


#: The planes with characters: 0 to 3 and 14, without surrogates. The others are unassigned or for private use.
_POINTS = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)]


def _tables() -> tuple[dict[str, str], dict[str, str], str]:
    """(character -> decomposed plain form where they differ, decomposed cluster -> composed character, all combining marks)."""
    plain, composed, marks = {}, {}, []
    for ch in map(chr, _POINTS):
        if "\uac00" <= ch <= "\ud7a3" or ud.category(ch) in ("Cn", "Co"):
            continue
        if ud.combining(ch):
            marks.append(ch)
        to = _decompose(ch)
        if to != ch:
            plain[ch] = to
        nfd = ud.normalize("NFD", ch)
        if len(nfd) > 1 and ud.normalize("NFC", nfd) == ch and not ud.combining(nfd[0]):
            composed[nfd] = ch
    return plain, composed, "".join(marks)


PLAIN, COMPOSED, COMBINING = _tables()


#: Unicode's primary compositions of two characters: first + second -> composed character.
PAIRS = {}
for _ch in map(chr, _POINTS):
    _dec = ud.decomposition(_ch)
    if _dec and not _dec.startswith("<") and " " in _dec and ud.normalize("NFC", _ch) == _ch:
        PAIRS["".join(chr(int(x, 16)) for x in _dec.split())] = _ch
#: Those whose second character is no combining mark, and those that begin with their results.
STARTER_PAIRS = {k: v for k, v in PAIRS.items() if not ud.combining(k[1])}
STARTER_PAIRS |= {k: v for k, v in PAIRS.items() if k[0] in set(STARTER_PAIRS.values())}


def char_class(chars) -> str:
    """A regex class (without brackets) of ``chars`` as ranges, valid for Python and Java."""
    cps, out = sorted({ord(c) for c in chars}), []
    for cp in cps:
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    esc = lambda x: f"\\u{x:04X}" if x < 0x10000 else chr(x)
    return "".join(esc(a) if a == b else f"{esc(a)}-{esc(b)}" for a, b in out)


#: Characters that may change: all with another plain form, unless that form is just their own decomposition.
CHANGED = {c: ud.normalize("NFC", d) for c, d in PLAIN.items() if ud.normalize("NFC", d) != c}
_CHANGED = re.compile(f"[{char_class(c for c in CHANGED if c != ' ')}]")
_BLANKS = re.compile(" {2,}")
_M = re.escape(MARKS)
_MARK = re.compile(f"[{_M}](?:(?![0-9])|(?<![0-9].))")


def form(text: str) -> str:
    """The consistent form: plain shapes, composed accents, single blanks, no invisible characters."""
    if not text.isascii():
        text = _CHANGED.sub(lambda m: CHANGED[m[0]], text)
        if not ud.is_normalized("NFC", text):
            text = ud.normalize("NFC", text)
            if _CHANGED.search(text):  # a composition may itself have a plain form
                text = ud.normalize("NFC", _CHANGED.sub(lambda m: CHANGED[m[0]], text))
    return " ".join(text.split())


def words(text: str) -> list[str]:
    """The words: consistent form without marks (but marks between two digits), case folded, split at blanks."""
    return _MARK.sub("", form(text)).casefold().split()


def bare(text: str) -> str:
    """The words joined without blanks."""
    return "".join(words(text))
