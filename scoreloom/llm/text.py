"""Repair and folding of typed and scraped text, on single strings."""

from __future__ import annotations

import html
import re
import unicodedata

# ---------------------------------------------------------------- fixed values
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKE = dict(zip("асеорхуіѕјԁһԛԝкмтвнАСЕОРХУІЅЈВКМНТανορτΑΒΕΗΙΚΜΝΟΡΤΥΧΖ", "aceopxyisjdhqwkmtbHACEOPXYISJBKMHTavoptABEHIKMNOPTYXZ"))
SPECIAL = {"ß": "ss", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ı": "i", "ð": "d", "þ": "th"}
# ---------------------------------------------------------------- end of fixed values

INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]|[\U000e0000-\U000e007f]")
CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x84\x86-\x9f]")
_TAIL = "\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2026\u2030\u2039\u203a\u20ac\u2122"
BROKEN = re.compile(f"(?:[Â-ß][{_TAIL}]|[à-ï][{_TAIL}]{{2}}|[ð-ô][{_TAIL}]{{3}})+")


def _mend(m: re.Match) -> str:
    out = bytearray()
    for c in m.group():
        if ord(c) < 256:
            out.append(ord(c))
        else:
            out += c.encode("cp1252", "replace")
    try:
        return out.decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def repair(s: str) -> str:
    """Undo HTML entities, ``\\uXXXX`` escapes and UTF-8 read as Latin-1 (each up to
    twice), drop invisible characters, bring forms to NFKC, make controls spaces."""
    for _ in range(2):
        if "&" in s and ";" in s:
            s = html.unescape(s)
    if "\\u" in s:
        s = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), s)
        s = s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    for _ in range(2):
        t = BROKEN.sub(_mend, s)
        if t == s:
            break
        s = t
    if s.isascii():
        return CONTROL.sub(" ", s)
    s = INVISIBLE.sub("", s)
    return CONTROL.sub(" ", s if unicodedata.is_normalized("NFKC", s) else unicodedata.normalize("NFKC", s))


_found = {c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))}
_MARKS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(sorted(c for c in _found if c - 1 not in _found), sorted(c for c in _found if c + 1 not in _found))) + "]+")


def _spelled(s: str) -> str:
    """Lower case, letters that don't decompose spelled out, the others set apart from
    their marks."""
    for a, b in SPECIAL.items():
        if a in s:
            s = s.replace(a, b)
    return unicodedata.normalize("NFKD", s.lower())


def fold(s: str) -> str:
    """Lower case without diacritics."""
    if s.isascii():
        return s.lower()
    return _MARKS.sub("", _spelled(s))


def is_cyrillic(s: str) -> bool:
    return not s.isascii() and any("Ѐ" <= c <= "ӿ" for c in s)


_LOOK = re.compile("[" + "".join(LOOKALIKE) + "]")
_MIXED = re.compile(r"\b[^\W\d_]+\b")


def _latin(m: re.Match) -> str:
    w = m.group()
    if w.isascii() or not _LOOK.search(w):
        return w
    t = _LOOK.sub(lambda c: LOOKALIKE[c.group()], w)
    return t if re.search("[A-Za-z]", w) or t.isascii() and len(t) < 4 else w


def delook(s: str) -> str:
    """Words that mix scripts, with their look-alike letters made Latin; so too short
    words of look-alikes alone. Other words keep their script."""
    return s if s.isascii() or not _LOOK.search(s) else _MIXED.sub(_latin, s)


_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<\|?/?[a-z_]+\|?>")


_KEEP = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
_DROP = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalnum())


def letters(s: str) -> bytes:
    """``stream`` as bytes."""
    s = _TAG.sub(" ", delook(repair(s)))
    if not s.isascii():
        s = _spelled(s)  # marks and other scripts are no ASCII
    return s.encode("ascii", "ignore").translate(_KEEP, _DROP)


def stream(s: str) -> str:
    """The bare run of lower-case letters and digits: layout, case, punctuation,
    markup and broken encodings no longer matter."""
    return letters(s).decode("ascii")
