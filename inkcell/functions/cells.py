"""Braille ASCII, Unicode braille and cell arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import ALIAS, BRAILLE_ASCII

UNICODE_CELLS = "".join(chr(0x2800 + i) for i in range(64))
#: Every accepted character and its lower-case, alias-free form: 91 in all.
ACCEPTED = BRAILLE_ASCII + BRAILLE_ASCII.upper().translate({ord(c): None for c in BRAILLE_ASCII}) + ALIAS
PLAIN = "".join(c if c in BRAILLE_ASCII else "@" if c == ALIAS else c.lower() for c in ACCEPTED)
AS_UNICODE = PLAIN.translate({ord(a): u for a, u in zip(BRAILLE_ASCII, UNICODE_CELLS, strict=True)})
ALL_CELLS = "".join(chr(0x2800 + i) for i in range(256))


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in chars)


KNOWN_CLASS = _class(ACCEPTED)


def normalize(x: Column) -> Column:
    """The alias as the standard character; nothing else changes."""
    return F.translate(x, ALIAS, "@")


def to_unicode(x: Column, unknown: str = "�") -> Column:
    """Braille ASCII to Unicode cells; line ends and form feeds stay."""
    return F.translate(F.regexp_replace(x, f"[^{KNOWN_CLASS}\\n\\r\\f]", unknown), ACCEPTED, AS_UNICODE)


def from_unicode(x: Column, unknown: str = "?") -> Column:
    """Unicode cells (eight-dot ones by their lower six) and Braille ASCII to plain Braille ASCII."""
    known = F.regexp_replace(x, f"[^{KNOWN_CLASS}⠀-⣿\\n\\r\\f]", unknown)
    return F.translate(known, ALL_CELLS + ACCEPTED, BRAILLE_ASCII * 4 + PLAIN)


def round_trip_ok(x: Column) -> Column:
    """Whether only accepted characters occur, so that both conversions give the plain form back."""
    return ~x.rlike(f"[^{KNOWN_CLASS}\\n\\r\\f]") & (from_unicode(to_unicode(x)) == F.translate(x, ACCEPTED, PLAIN))


def dots(x: Column) -> Column:
    """Dot mask 0-63 of one character; null if it isn't accepted."""
    at = F.instr(F.lit(BRAILLE_ASCII), F.translate(x, ACCEPTED, PLAIN))
    return F.when((F.length(x) == 1) & (at > 0), at - 1)


def dot_char(n: Column) -> Column:
    """The character of a dot mask's lower six bits."""
    return F.substring(F.lit(BRAILLE_ASCII), n.bitwiseAND(F.lit(63)) + 1, F.lit(1))


def cells(x: Column) -> Column:
    """Dot masks of all characters; 0 for a blank and for what isn't accepted."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.coalesce(dots(c), F.lit(0)))
