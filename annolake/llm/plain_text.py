"""A readable form of a damaged text with the way back: which raw character each one came from.

Entities, full-width and compatibility characters, UTF-8 read as Latin-1, odd blanks and dashes
become what they stand for; invisible characters and plain tags vanish. One regular expression
finds the places; text between them is untouched, so an ordinary text costs one scan."""

from __future__ import annotations

import bisect
import html
import re
import unicodedata

_CONT = "[\x80-\xbfŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]"
_SPECIAL = re.compile(
    rf"&(?:#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z]{{2,8}});"
    r"|[A-Za-z][\u0300-\u036f]+"  # decomposed accents
    r"|</?(?:p|b|i|u|br|hr|em|li|ul|ol|td|tr|th|div|span|code|pre|strong|small|table|h[1-6])(?:\s[^<>@]{0,80})?/?>"
    rf"|[\xc3-\xdf]{_CONT}|[\xe0-\xef]{_CONT}{{2}}|[\xf0-\xf4]{_CONT}{{3}}|\xc2[\xa0-\xbf]"
    "|[­​-‏‪-‮⁠-⁤﻿]"
    "|[\xa0   -   　]|[‐-―−]|[’‘ʼ′]|[！-～]|[⁰-₉①-⓿㈀-㋿ﬀ-ﬆ]"
)
_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _remojibake(s: str) -> str | None:
    try:
        return bytes(_CP1252.get(c, ord(c)) for c in s).decode("utf-8")
    except (UnicodeDecodeError, ValueError):
        return None


def _plain(s: str) -> str:
    c = s[0]
    if c == "&" and len(s) > 1:
        u = html.unescape(s)
        return s if u == s else _plain(u) if len(u) == 1 and not u.isascii() else u
    if c == "<":
        return ""
    if "Â" <= c <= "ô" and len(s) > 1:
        u = _remojibake(s)
        return s if u is None else _plain(u) if len(u) == 1 and _SPECIAL.fullmatch(u) else u
    if c in "‐‑‒–—―−":
        return "-"
    if c in "’‘ʼ′":
        return "'"
    if unicodedata.category(c) == "Cf":
        return ""
    u = unicodedata.normalize("NFKC", s)
    return " " if u.isspace() else u


class Plain:
    """``text`` and ``raw(place)``, the raw place of a character of it."""

    __slots__ = ("text", "_at", "_raw")

    def __init__(self, raw: str) -> None:
        parts, at, back, last, n = [], [0], [0], 0, 0
        for m in _SPECIAL.finditer(raw):
            u = _plain(m.group())
            if u == m.group():
                continue
            parts += (raw[last : m.start()], u)
            n += m.start() - last
            # the replacement's characters all go back to its start, what follows to its end
            for k in range(len(u)):
                at.append(n + k)
                back.append(m.start())
            n += len(u)
            at.append(n)
            back.append(m.end())
            last = m.end()
        parts.append(raw[last:])
        self.text, self._at, self._raw = "".join(parts) if last else raw, at, back

    def raw(self, place: int) -> int:
        k = bisect.bisect_right(self._at, place) - 1
        return self._raw[k] + place - self._at[k]

    def raw_end(self, end: int) -> int:
        """The raw end of a stretch that ends before ``end``."""
        return self.raw(end - 1) + 1 if end and self.raw(end) - self.raw(end - 1) <= 1 else self.raw(end)
