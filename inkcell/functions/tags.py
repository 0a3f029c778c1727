"""Structure candidates of blocks and lines, line kinds and segment keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import DIGIT_CELLS, DIGITS, TAG_PRIORITY
from .text import strip

# The patterns that mark structure.
PASSAGE = r"\[\s*[0-9]{1,2}\s*[~\-–—]\s*[0-9]{1,2}\s*\]"
QUESTION = r"(?:^|\n)\s*(?:([0-9]{1,2})\s*[\.．。]|([0-9]{1,2})\s+)"
CHOICE = r"(?:^|\n)\s*(?:[①②③④⑤]|[1-5]\s*[\)］\]]|[ㄱㄴㄷㄹㅁ]\s*[\.．]|[1-5]\s*번\s*선택)"
EXAMPLE = r"〈\s*보\s*기\s*〉|<\s*보\s*기\s*>|【\s*보\s*기\s*】"
FOOTNOTE = r"(?:^|\n)\s*\*"
ENDING = r"시험이\s*끝났|문제지.*거두|수고하셨"
BLOCK_START = r"^\s*(?:\[\s*[0-9]{1,2}\s*[~\-–—]\s*[0-9]{1,2}\s*\]|[0-9]{1,2}\s*[\.．。]|[①②③④⑤]|[1-5]\s*[\)］\]]|[ㄱㄴㄷㄹㅁ]\s*[\.．]|〈\s*보\s*기\s*〉|<\s*보\s*기\s*>|【\s*보\s*기\s*】|━{5,}|─{5,}|_{5,}|={5,})"
LINE_RULE = r"^\s*(?:={6,}|-{6,}|\.{6,}|\*{6,}|_{6,}|=[gG]{5,}=|[gG]{8,})\s*$"
LINE_QUESTION_EXAM = r"(?:^|\s)(?:ja,r7\s*)?#([a-jA-J]{1,2})\"1"
LINE_QUESTION = r"^\s*#([a-jA-J]{1,2})(?:[-\.]|[ ]|$)"
LINE_CHOICE_EXAM = r"(?:^|\s)#([a-eA-E])\"[0-9a-zA-Z]"
LINE_CHOICE = r"^\s*(#[a-eA-E])\s+"
INK_CHOICE = r"(?:^|\s)(?:[①②③④⑤]|[1-5]\)|[ㄱㄴㄷㄹㅁ]\.)"
INK_HEADER = r"쪽|페이지|국어|문항|수능|모의|영역|교시"
INK_QUESTION = r"(?:^|\s)[0-9]{1,2}\s*번"
KIND_RULE = r"^=[gG=.\-_]*="
KIND_RULE_CHARS = r"^[=gG\-._* ]{6,}$"
PASSAGE_CELLS = r"82#([a-jA-J]+)`9#([a-jA-J]+);0"
QUESTION_CELLS = r"^\s*#([a-jA-J]+)4\b"
PASSAGE_INK = r"\[\s*[0-9]{1,2}\s*[~\-–—～]\s*[0-9]{1,2}\s*\]|다음.+(?:물음|발표|글|토의)"
PASSAGE_INK_RANGE = r"\[\s*([0-9]{1,2})\s*[~\-–—～]\s*([0-9]{1,2})\s*\]"
QUESTION_INK = r"^\s*([0-9]{1,2})\s*[\.．。]"
GUIDANCE = (
    r"안내|유의\s*사항|점자\s*문제|시각\s*장애|이\s*문제지|답안지|컴퓨터용|사인펜|수정\s*테이프|문항\s*번호"
    r"|선택지|해당\s*번호|뒷면|넘기|끝\s*입니다|수고|점역|점자\s*교재|점자\s*도서"
)


def _tags(*pairs: tuple[Column, str]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(tag)) for c, tag in pairs))))


def cell_number(x: Column) -> Column:
    """The whole number of digit cells."""
    return F.translate(F.lower(x), DIGIT_CELLS, DIGITS).cast("int")


def question_number(x: Column) -> Column:
    """Number of the first question mark of a block; null without one."""
    n = F.coalesce(F.nullif(F.regexp_extract(x, QUESTION, 1), F.lit("")), F.nullif(F.regexp_extract(x, QUESTION, 2), F.lit("")))
    return n.cast("int")


def block_candidates(x: Column, band: Column | None = None) -> Column:
    """Ordered tags of a block; a head or foot band decides alone. Only the first question mark counts."""
    band = F.lit(None).cast("string") if band is None else band
    passage = x.rlike(PASSAGE)
    tags = _tags(
        (passage, "PassageGroup"), (~passage & F.coalesce(question_number(x).between(1, 45), F.lit(False)), "Question"),
        (x.rlike(CHOICE), "Choice"), (x.rlike(EXAMPLE), "ExampleBox"), (x.rlike(FOOTNOTE), "Footnote"), (x.rlike(ENDING), "EndNotice"),
    )
    none = F.array().cast("array<string>")
    return (
        F.when(F.coalesce(strip(x), F.lit("")) == "", none)
        .when(band == "header", F.array(F.lit("Header")))
        .when(band == "footer", F.array(F.lit("Footer")))
        .otherwise(tags)
    )


def line_candidates(raw: Column, ink: Column | None = None) -> Column:
    """Ordered tags of a braille line, with its decoded ink if that is given."""
    x = F.regexp_replace(raw, r"[\n\r]+$", "")
    ok = lambda pattern: x.rlike(pattern) & F.coalesce(cell_number(F.regexp_extract(x, pattern, 1)).between(1, 45), F.lit(False))
    exam, start = ok(LINE_QUESTION_EXAM), ok(LINE_QUESTION)
    question = exam | start
    more = start & (strip(F.regexp_replace(x, LINE_QUESTION, "")) != "")
    choice = ~question & (x.rlike(LINE_CHOICE_EXAM) | x.rlike(LINE_CHOICE))
    pairs = [(x.rlike(LINE_RULE), "Separator"), (question, "Question"), (more, "Prompt"), (choice, "Choice")]
    if ink is not None:
        has = F.coalesce(ink, F.lit(""))
        pairs += [(has.rlike(INK_CHOICE), "Choice"), (has.rlike(INK_HEADER), "Header"), (has.rlike(INK_QUESTION), "Question")]
    return F.when(x == "", F.array().cast("array<string>")).otherwise(_tags(*pairs))


def primary_tag(tags: Column, candidates: Column) -> Column:
    """The first tag by priority; given tags replace candidates where there are any."""
    use = F.when(F.size(tags) > 0, tags).otherwise(candidates)
    return F.coalesce(*(F.when(F.array_contains(use, name), F.lit(name)) for name in TAG_PRIORITY))


def line_kind(cells: Column, ink: Column) -> Column:
    """blank, separator, passage_group, question, guidance or body; the first that holds."""
    s = strip(cells)
    return (
        F.when(s == "", "blank")
        .when(s.rlike(KIND_RULE) | s.rlike(KIND_RULE_CHARS), "separator")
        .when(s.rlike(PASSAGE_CELLS) | ink.rlike(PASSAGE_INK), "passage_group")
        .when(s.rlike(QUESTION_CELLS) | ink.rlike(QUESTION_INK), "question")
        .when(ink.rlike(GUIDANCE), "guidance")
        .otherwise("body")
    )


def passage_key(cells: Column, ink: Column) -> Column:
    pair = lambda a, b: F.concat(F.lit("passage:"), a.cast("string"), F.lit("-"), b.cast("string"))
    return (
        F.when(cells.rlike(PASSAGE_CELLS), pair(cell_number(F.regexp_extract(cells, PASSAGE_CELLS, 1)), cell_number(F.regexp_extract(cells, PASSAGE_CELLS, 2))))
        .when(ink.rlike(PASSAGE_INK_RANGE), pair(F.regexp_extract(ink, PASSAGE_INK_RANGE, 1).cast("int"), F.regexp_extract(ink, PASSAGE_INK_RANGE, 2).cast("int")))
        .otherwise("passage:unknown")
    )


def question_key(cells: Column, ink: Column) -> Column:
    s = strip(cells)
    key = lambda n: F.concat(F.lit("question:"), n.cast("string"))
    return (
        F.when(s.rlike(QUESTION_CELLS), key(cell_number(F.regexp_extract(s, QUESTION_CELLS, 1))))
        .when(ink.rlike(QUESTION_INK), key(F.regexp_extract(ink, QUESTION_INK, 1).cast("int")))
        .otherwise("question:unknown")
    )


def key_rank(key: Column) -> Column:
    """struct for ordering keys: passages by range, then questions by number, then others."""
    a, b = F.regexp_extract(key, r"^passage:([0-9]+)-([0-9]+)$", 1), F.regexp_extract(key, r"^passage:([0-9]+)-([0-9]+)$", 2)
    n = F.regexp_extract(key, r"^question:([0-9]+)$", 1)
    num = lambda x: F.coalesce(F.nullif(x, F.lit("")).cast("int"), F.lit(0))
    kind = F.when(key.startswith("passage:"), 0).when(key.startswith("question:"), 1).otherwise(2)
    return F.struct(kind.alias("kind"), F.when(kind == 0, num(a)).when(kind == 1, num(n)).otherwise(0).alias("a"), F.when(kind == 0, num(b)).otherwise(0).alias("b"), key.alias("key"))
