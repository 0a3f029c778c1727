"""Text normalisation, clipping and running heads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space (of any script) at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def norm_line(x: Column) -> Column:
    """For comparing cells: the alias as @, nothing at the end; case counts."""
    return F.regexp_replace(F.translate(x, "`", "@"), r"(?U)\s+$", "")


def norm_ink(x: Column) -> Column:
    """For comparing content: lower case, no white space, no punctuation, one kind of tilde and dash."""
    bare = F.regexp_replace(F.lower(x), r"(?U)\s+", "")
    bare = F.regexp_replace(bare, "[·.?!,;:'\"\\[\\]()<>〈〉【】]", "")
    return F.translate(bare, "～—–", "~--")


def clip(x: Column, n: int) -> Column:
    """One line of at most n characters, an ellipsis if cut."""
    flat = strip(F.translate(x, "\n", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n - 1), F.lit("…")))


def skip_header(x: Column) -> Column:
    """Whether a running head gives no output: blank, a page number, a rule, or a bare subject line."""
    s = strip(F.coalesce(x, F.lit("")))
    subject = ~s.contains("학년도") & ~s.contains("교시") & s.contains("국어") & (F.length(s) < 24)
    return (s == "") | s.rlike("^[0-9]{1,3}$") | s.rlike(r"(?U)^[\s━─=_\-]+$") | (subject & (s.rlike(r"(?U)[0-9]\s*고[0-9]") | s.startswith("국어")))


def norm_spaces(x: Column) -> Column:
    s = strip(F.regexp_replace(x, r"(?U)\s+", " "))
    s = F.replace(s, F.lit("교시국어"), F.lit("교시 국어"))
    s = F.replace(s, F.lit("국어영역"), F.lit("국어 영역"))
    s = F.regexp_replace(s, r"고\s+([0-9])", "고$1")
    return F.regexp_replace(s, r"제\s*([0-9]+)\s*교시", "제$1교시")


TITLE = r"^([0-9]{4}\s*학년도\s+[0-9]+\s*월\s+고\s*[0-9])\s+(전국연합학력평가\s*문제지)(?:\s+[0-9]+)?\s*$"
PERIOD = r"^제([0-9]+)교시\s+국어\s+영역\s*$"


def header_lines(x: Column) -> Column:
    """array<struct<align, ink>> of a running head; empty if it is skipped."""
    s = norm_spaces(F.coalesce(x, F.lit("")))
    row = lambda align, ink: F.struct(F.lit(align).alias("align"), ink.alias("ink"))
    none = F.array().cast("array<struct<align:string,ink:string>>")
    rest = strip(F.regexp_replace(s, r"\s+[0-9]{1,3}\s*$", ""))
    return (
        F.when(skip_header(x), none)
        .when(s.rlike(TITLE), F.array(row("left", F.regexp_extract(s, TITLE, 1)), row("left", F.regexp_extract(s, TITLE, 2))))
        .when(s.rlike(PERIOD), F.array(row("center", F.concat(F.lit("제"), F.regexp_extract(s, PERIOD, 1), F.lit("교시"))), row("center", F.lit("국어 영역"))))
        .when((rest != "") & ~skip_header(rest), F.array(row("left", rest)))
        .otherwise(none)
    )


def pad_header(align: Column, cells: Column, width: int = 32) -> Column:
    """A head line in place: cut at the width, centred, or two blanks in (which may pass the width by one)."""
    body = strip(cells)
    lead = F.when(align == "center", F.floor((F.lit(width) - F.length(body)) / 2).cast("int")).otherwise(F.lit(2))
    return F.when(F.length(body) >= width, F.substring(body, 1, width)).when(body == "", "").otherwise(F.concat(F.repeat(F.lit(" "), lead), body))
