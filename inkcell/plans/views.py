"""The star-schema and text tables seen as the engine's own tables, once in Spark and once as SQL.

The two forms of a view use the same arithmetic, so a query over one can be held against SQL over the other.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.whole import Spans

# 26 syllables for a-z that cover plain, tensed, abbreviated and double-final cells.
SYLLABLES = "가나다라마바사아자차카타파하것억옹울연을까씨꽃값닭괜"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PAGE = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, beyond: int | None = None) -> DataFrame:
    """doc_id, n, page_index, line_index, raw_ascii: 26 lines of a document's text are a page. ``beyond``: of texts of
    more characters only."""
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    docs = table(spark, sf_dir, "documents")
    rows = (docs if beyond is None else docs.where(long_text(beyond))).select("doc_id", split.alias("n", "raw_ascii"))
    return rows.select("doc_id", "n", F.expr(f"int(n div {PAGE})").alias("page_index"), F.expr(f"n % {PAGE}").alias("line_index"), "raw_ascii")


def long_text(beyond: int) -> Column:
    return F.coalesce(F.length("text"), F.lit(0)) > beyond


LINES = f"""
l as (
  select doc_id, (i - 1)::int as n, ((i - 1) // {PAGE})::int as page_index, ((i - 1) % {PAGE})::int as line_index, s[i] as raw_ascii
  from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents))
)"""


def fed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the lines again, pages joined by form feeds."""
    s = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    docs = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    pages = F.expr(f"transform(sequence(0, (size(s) - 1) div {PAGE}), p -> array_join(slice(s, int(p * {PAGE} + 1), {PAGE}), '\\n'))")
    return docs.select("doc_id", F.array_join(pages, "\x0c").alias("text"))


#: Pages of ``fed_texts`` as they are parsed: the last one is dropped if it is empty and not the only one.
FED = f"""
fed as (
  select doc_id, list_transform(range(0, (len(s) - 1) // {PAGE} + 1), lambda p: array_to_string(s[(p * {PAGE} + 1)::bigint : (p * {PAGE} + {PAGE})::bigint], chr(10))) as pages
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)
), kept as (
  select doc_id, len(pages) > 1 and pages[-1] = '' as feed, case when len(pages) > 1 and pages[-1] = '' then pages[1 : len(pages) - 1] else pages end as pages from fed
), pg as (select doc_id, feed, (p - 1)::int as page_index, pages[p] as page from (select *, unnest(range(1, len(pages) + 1)) as p from kept)),
pl as (
  select doc_id, page_index, (i - 1)::int as line_index, s[i] as raw_ascii from (
    select doc_id, page_index, s, unnest(range(1, len(s) + 1)) as i from (
      select doc_id, page_index, case when page = '' then [] when right(page, 1) = chr(10) then string_split(left(page, length(page) - 1), chr(10)) else string_split(page, chr(10)) end as s from pg))
)"""


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Generated lines, and a reference with e and o exchanged; each side has some lines at places where the other
    has none."""
    rows = lines(spark, sf_dir)
    moved = lambda k, by: rows.withColumn("line_index", F.expr(f"if((doc_id + n) % {k} = 0, line_index + {by}, line_index)"))
    return moved(11, PAGE), moved(7, 2 * PAGE).withColumn("raw_ascii", F.translate("raw_ascii", "eo", "oe"))


PAIR = LINES + f""",
g as (select doc_id, n, page_index, case when (doc_id + n) % 11 = 0 then line_index + {PAGE} else line_index end as line_index, raw_ascii from l),
r as (select doc_id, n, page_index, case when (doc_id + n) % 7 = 0 then line_index + {2 * PAGE} else line_index end as line_index, translate(raw_ascii, 'eo', 'oe') as raw_ascii from l)"""


def ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with letters as Hangul; some begin with a question number, some hold a passage range."""
    rows = lines(spark, sf_dir)
    text = F.translate(F.lower("raw_ascii"), LETTERS, SYLLABLES)
    head = F.expr("case when n % 5 = 0 then concat(string(n % 50), '. ') when n % 7 = 0 then concat('[', string(n % 40), '~', string(n % 40 + 3), '] ') else '' end")
    return rows.select("doc_id", "n", F.concat(head, text).alias("ink"))


INK = LINES + f""",
k as (
  select doc_id, n, (case when n % 5 = 0 then (n % 50)::varchar || '. ' when n % 7 = 0 then '[' || (n % 40)::varchar || '~' || (n % 40 + 3)::varchar || '] ' else '' end)
    || translate(lower(raw_ascii), '{LETTERS}', '{SYLLABLES}') as ink from l
)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in time as the blocks of a document."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as doc_id", "1 as page_number", "row_number() over (partition by user_id order by ts, event_id) - 1 as reading_order", "concat('b', event_id) as id",
        "case when event_id % 11 = 0 then case event_id % 3 when 0 then '2026 학년도 6월 고2 전국연합학력평가 문제지 3' when 1 then '제 1 교시국어영역' else concat('head ', event_id) end when event_type = 'signup' then '[1~3] signup' when event_type = 'view' then concat(event_id % 50, '. view') else concat(event_type, ' ', event_id) end as text",
        """case when event_id % 11 = 0 then 'Header' when event_type = 'signup' then 'PassageGroup' when event_type = 'view' then 'Question' when event_type = 'click' then 'Choice' when event_type = 'error' then 'Footer'
           else case when event_id % 5 = 0 then 'ExampleBox' when event_id % 7 = 0 then 'Footnote' end end as tag""",
    )


TREE = r"""
vb as (
  select user_id as doc_id, 1 as page_number, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as reading_order, 'b' || event_id as id,
    case when event_id % 11 = 0 then case event_id % 3 when 0 then '2026 학년도 6월 고2 전국연합학력평가 문제지 3' when 1 then '제 1 교시국어영역' else 'head ' || event_id end when event_type = 'signup' then '[1~3] signup' when event_type = 'view' then (event_id % 50) || '. view' else event_type || ' ' || event_id end as text,
    case when event_id % 11 = 0 then 'Header' when event_type = 'signup' then 'PassageGroup' when event_type = 'view' then 'Question' when event_type = 'click' then 'Choice' when event_type = 'error' then 'Footer'
      else case when event_id % 5 = 0 then 'ExampleBox' when event_id % 7 = 0 then 'Footnote' end end as tag
  from events
), e1 as (
  select *, row_number() over w as pos, sum(case when tag in ('PassageGroup', 'Header', 'Footer') then 1 else 0 end) over w as epoch,
    sum(case when tag = 'PassageGroup' then 1 else 0 end) over w as gno
  from vb window w as (partition by doc_id order by reading_order rows unbounded preceding)
), e2 as (select *, case when tag = 'PassageGroup' then 'passage-group-' || gno::bigint else id end as node_id from e1),
e3 as (
  select *, max(case when tag = 'PassageGroup' then node_id end) over w as g, last_value(case when tag = 'Question' then node_id end ignore nulls) over w as q
  from e2 window w as (partition by doc_id, epoch order by pos rows unbounded preceding)
), e4 as (select *, sum(case when tag is null then 1 else 0 end) over (partition by doc_id, epoch, q order by pos rows unbounded preceding) as nth from e3),
asg as (
  select doc_id, pos, epoch, id, node_id, text,
    case when tag in ('PassageGroup', 'Question', 'Footnote', 'ExampleBox', 'Header', 'Footer') then tag when tag = 'Choice' then case when q is null then 'Unknown' else 'Choice' end
      when q is not null then case when nth = 1 then 'Prompt' else 'Paragraph' end when g is not null then 'Passage' else 'Unknown' end as node_type,
    case when tag in ('PassageGroup', 'Header', 'Footer') then 'exam-root' when tag in ('Question', 'Footnote') then coalesce(g, 'exam-root')
      when tag = 'Choice' then coalesce(q, 'exam-root') else coalesce(q, g, 'exam-root') end as parent_id
  from e4
), pl0 as (select *, case when node_type = 'PassageGroup' then max(pos) over (partition by doc_id, epoch) + 0.5 else pos::double end as place from asg),
pl1 as (
  select a.*, list_filter([c.place, b.place, a.place], lambda x: x is not null) as path
  from pl0 a left join pl0 b on a.doc_id = b.doc_id and a.parent_id = b.node_id left join pl0 c on b.doc_id = c.doc_id and b.parent_id = c.node_id
), tr as (
  select doc_id, id, node_id, node_type, parent_id, text, len(path)::int as depth, row_number() over (partition by doc_id order by path, node_id)::int as dfs_order,
    (row_number() over (partition by doc_id, parent_id order by place, node_id) - 1)::int as child_ordinal,
    case when node_type = 'Question' then regexp_extract(text, '^([0-9]{1,2})', 1)::int end as question_number,
    node_type in ('PassageGroup', 'Passage', 'Question', 'Prompt', 'Choice', 'ExampleBox', 'Footnote', 'Instruction') as is_nav
  from pl1
)"""

#: Profile of ``spans``: two columns of 595 x 842.
PROFILE = {"page_width": 595.0, "page_height": 842.0, "column_cut_x": 320.0, "header_bottom_y": 80.0, "footer_top_y": 410.0}


def spans(spark: SparkSession, sf_dir: str, beyond: int | None = None) -> DataFrame:
    """Words of whole lines, flowed in rows of 50 characters on two-column pages of 50 rows; every third page has a
    rule at its top."""
    rows = lines(spark, sf_dir, beyond).selectExpr("doc_id", "n", "raw_ascii", "greatest(length(raw_ascii) - 1, 0) div 50 + 1 as tall")
    rows = rows.selectExpr("doc_id", "n", "raw_ascii", "sum(tall) over (partition by doc_id order by n) - tall as base", "sum(length(raw_ascii) + 1) over (partition by doc_id order by n) - length(raw_ascii) - 1 as spot")
    rows = rows.selectExpr("doc_id", "n", "base", "spot", "posexplode(split(raw_ascii, ' ', -1)) as (i, t)")
    rows = rows.selectExpr("*", "sum(length(t) + 1) over (partition by doc_id, n order by i) - length(t) - 1 as before").where("t <> ''")
    rows = rows.selectExpr("*", "int((base + before div 50) % 50) as r", "int((base + before div 50) div 50) + 1 as page_number", "int(before % 50) as c")
    # the right halves of some rows stand a little lower: within a line's height in one of three, beyond it in another
    rows = rows.selectExpr("*", "72 + 14 * (r % 25) + case when c < 25 or r % 25 in (0, 24) or r % 3 = 2 then 0 when r % 3 = 1 then 5.5D else 2 end as y")
    words = rows.selectExpr(
        "doc_id", "page_number", "concat('s', n, '-', i) as id", "if(i = 0, t, concat(' ', t)) as text",
        "double(40 + 5 * c + if(r >= 25, 290, 0)) as x0", "double(y) as y0", "double(40 + 5 * (c + length(t)) + if(r >= 25, 290, 0)) as x1", "double(y + 11) as y1",
        "11D as font_size", "int(spot + before) as extraction_index",
    )
    rules = words.where("page_number % 3 = 0").select("doc_id", "page_number").distinct().selectExpr(
        "doc_id", "page_number", "concat('rule', page_number) as id", "repeat('=', 12) as text", "40D as x0", "double(58 + page_number % 5) as y0", "540D as x1", "double(60 + page_number % 5) as y1", "11D as font_size", "-1 as extraction_index")
    return words.unionByName(rules)


def span_arrays(texts: list[str | None]) -> Spans:
    """``spans`` of some documents' texts, as arrays."""
    split = [(x or "").split("\n") for x in texts]
    rows = list(chain.from_iterable(split))
    before = lambda size, many: (t := np.cumsum(size) - size) - np.repeat(t[np.cumsum(many) - many], many)
    per = np.fromiter(map(len, split), np.int64, len(split))
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    base, spot = before(np.maximum(size - 1, 0) // 50 + 1, per), before(size + 1, per)
    parts = [x.split(" ") for x in rows]
    many = np.fromiter(map(len, parts), np.int64, len(parts))
    words = list(chain.from_iterable(parts))
    size = np.fromiter(map(len, words), np.int64, len(words))
    at, row = before(size + 1, many), np.repeat(np.arange(len(rows)), many)
    kept = size > 0
    first = np.cumsum(many) - many
    text = [" " + t for t in words]
    for i in first.tolist():
        text[i] = words[i]
    text = [t for t, k in zip(text, kept.tolist(), strict=True) if k]
    size, at, row = size[kept], at[kept], row[kept]
    doc = np.repeat(np.arange(len(texts)), per)[row]
    tall = base[row] + at // 50
    r, page, c = tall % 50, tall // 50 + 1, at % 50
    lower = np.where((c < 25) | np.isin(r % 25, (0, 24)) | (r % 3 == 2), 0.0, np.where(r % 3 == 1, 5.5, 2.0))
    y, x = 72 + 14 * (r % 25) + lower, 40.0 + 5 * c + np.where(r >= 25, 290, 0)
    third = page % 3 == 0
    ruled = np.unique((doc[third] << 32) | page[third])
    n, low = len(ruled), (ruled & 0xFFFFFFFF) % 5
    join = lambda a, b: np.concatenate((a, b))
    return Spans(
        join(doc, ruled >> 32), join(page, ruled & 0xFFFFFFFF), text + ["=" * 12] * n, join(x, np.full(n, 40.0)), join(y, 58.0 + low), join(x + 5 * size, np.full(n, 540.0)), join(y + 11, 60.0 + low),
        np.full(len(doc) + n, 11.0), join(spot[row] + at, np.full(n, -1)))


SPANS = LINES + """,
w0 as (select doc_id, n, raw_ascii, greatest(length(raw_ascii) - 1, 0) // 50 + 1 as tall from l),
w1 as (select doc_id, n, string_split(raw_ascii, ' ') as w, sum(tall) over v - tall as base, sum(length(raw_ascii) + 1) over v - length(raw_ascii) - 1 as spot from w0 window v as (partition by doc_id order by n rows unbounded preceding)),
w2 as (select doc_id, n, base, spot, i, w[i] as t from (select *, unnest(range(1, len(w) + 1)) as i from w1)),
w3 as (select *, (sum(length(t) + 1) over (partition by doc_id, n order by i rows unbounded preceding) - length(t) - 1)::bigint as before from w2),
w4 as (select *, ((base::bigint + before // 50) % 50)::int as r, ((base::bigint + before // 50) // 50 + 1)::int as page_number, before % 50 as c from w3 where t <> ''),
w5 as (
  select doc_id, page_number, 's' || n || '-' || (i - 1) as id, case when i = 1 then t else ' ' || t end as text, (spot + before)::int as extraction_index,
    (40 + 5 * c + case when r >= 25 then 290 else 0 end)::double as x0, (72 + 14 * (r % 25) + dy)::double as y0,
    (40 + 5 * (c + length(t)) + case when r >= 25 then 290 else 0 end)::double as x1, (83 + 14 * (r % 25) + dy)::double as y1
  from (select *, case when c < 25 or r % 25 in (0, 24) or r % 3 = 2 then 0 when r % 3 = 1 then 5.5 else 2 end as dy from w4)
), sp as (
  select * from w5 union all
  select distinct doc_id, page_number, 'rule' || page_number, repeat('=', 12), -1, 40::double, (58 + page_number % 5)::double, 540::double, (60 + page_number % 5)::double from w5 where page_number % 3 = 0
), sc as (
  select *, case when y0 < 80 then -2 when y0 >= 410 then 2 when x1 - x0 > 595 * 0.5 then -1 when (x0 + x1) / 2 < 320 then 0 else 1 end as col from sp
)"""


def span_row() -> Column:
    """The row of one of ``spans`` on its page: by steps of 14, what stands more than 5 lower is a row of its own."""
    step = F.floor((F.col("y0") - 72) / 14)
    return step * 2 + F.when(F.col("y0") - 72 - step * 14 > 5, 1).otherwise(0)


def profile(df: DataFrame) -> DataFrame:
    """``PROFILE`` for every document of ``df``."""
    return df.select("doc_id").distinct().select("doc_id", *(F.lit(v).alias(k) for k, v in PROFILE.items()))


def print_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with heights, gaps and outdents that vary; doc_id, page_number, col, id, text, box, reading_order."""
    return lines(spark, sf_dir).selectExpr(
        "doc_id", "page_index + 1 as page_number", "0 as col", "concat('l', n) as id", "raw_ascii as text", "double(40 + 6 * (n % 3)) as x0", "double(20 * line_index + 3 * (n % 4)) as y0",
        "double(40 + 6 * (n % 3) + length(raw_ascii)) as x1", "double(20 * line_index + 3 * (n % 4) + 9 + n % 5) as y1", "line_index as reading_order",
    )


PRINT_LINES = LINES + """,
p as (
  select doc_id, page_index + 1 as page_number, line_index, 'l' || n as id, raw_ascii as text, (40 + 6 * (n % 3))::double as x0, (20 * line_index + 3 * (n % 4))::double as y0,
    (20 * line_index + 3 * (n % 4) + 9 + n % 5)::double as y1 from l
), ph as (select *, list_sort(list(greatest(1::double, y1 - y0)) over (partition by doc_id, page_number)) as hs from p),
pb as (
  select *, hs[len(hs) // 2 + 1] as mh, y0 - lag(y1) over w as gap, x0 + 8 < lag(x0) over w as outdent, row_number() over w as rn,
    regexp_matches(text, '^\\s*(?:\\[\\s*[0-9]{1,2}\\s*[~\\-–—]\\s*[0-9]{1,2}\\s*\\]|[0-9]{1,2}\\s*[\\.．。]|[①②③④⑤]|[1-5]\\s*[\\)］\\]]|={5,}|_{5,})') as mark
  from ph window w as (partition by doc_id, page_number order by y0, x0, line_index)
), pn as (
  select *, sum(case when rn = 1 or mark or gap > mh * 0.85::double or (outdent and gap > mh * 0.5::double) then 1 else 0 end)
    over (partition by doc_id, page_number order by y0, x0, line_index rows unbounded preceding)::bigint as block_no from pb
)"""


def views_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose cells and ink make anchors, guidance, rules and blanks."""
    return lines(spark, sf_dir).selectExpr(
        "doc_id", "n as global_index",
        "case when n % 6 = 1 then concat('82#', translate(string(n % 9 + 1), '1234567890', 'abcdefghij'), '`9#', translate(string(n % 9 + 3), '1234567890', 'abcdefghij'), ';0') when n % 6 = 3 then concat('#', translate(string(n % 45 + 1), '1234567890', 'abcdefghij'), '4 x') when n % 13 = 0 then '=gggggg=' else raw_ascii end as raw_ascii",
        "case when n % 17 = 2 then concat('안내 ', raw_ascii) when n % 19 = 4 then concat(n % 45, '. ', raw_ascii) else raw_ascii end as ink",
    )


VIEWS_OF_LINES = LINES + r""",
v as (
  select doc_id, n as global_index,
    case when n % 6 = 1 then '82#' || translate((n % 9 + 1)::varchar, '1234567890', 'abcdefghij') || '`9#' || translate((n % 9 + 3)::varchar, '1234567890', 'abcdefghij') || ';0'
      when n % 6 = 3 then '#' || translate((n % 45 + 1)::varchar, '1234567890', 'abcdefghij') || '4 x' when n % 13 = 0 then '=gggggg=' else raw_ascii end as raw_ascii,
    case when n % 17 = 2 then '안내 ' || raw_ascii when n % 19 = 4 then (n % 45) || '. ' || raw_ascii else raw_ascii end as ink
  from l
), vt as (select *, regexp_replace(raw_ascii, '^\s+|\s+$', '', 'g') as s from v),
vk as (
  select *, case when s = '' then 'blank' when regexp_matches(s, '^=[gG=.\-_]*=') or regexp_matches(s, '^[=gG\-._* ]{6,}$') then 'separator'
    when regexp_matches(s, '82#([a-jA-J]+)`9#([a-jA-J]+);0') or regexp_matches(ink, '\[\s*[0-9]{1,2}\s*[~\-–—～]\s*[0-9]{1,2}\s*\]|다음.+(?:물음|발표|글|토의)') then 'passage_group'
    when regexp_matches(s, '^\s*#([a-jA-J]+)4\b') or regexp_matches(ink, '^\s*([0-9]{1,2})\s*[\.．。]') then 'question'
    when regexp_matches(ink, '안내|수고|점역') then 'guidance' else 'body' end as kind
  from vt
), vy as (
  select *, case when kind = 'passage_group' then case when regexp_matches(raw_ascii, '82#([a-jA-J]+)`9#([a-jA-J]+);0')
        then 'passage:' || translate(regexp_extract(raw_ascii, '82#([a-j]+)`9#([a-j]+);0', 1), 'abcdefghij', '1234567890')::int || '-' || translate(regexp_extract(raw_ascii, '82#([a-j]+)`9#([a-j]+);0', 2), 'abcdefghij', '1234567890')::int
        when regexp_matches(ink, '\[\s*([0-9]{1,2})\s*[~\-–—～]\s*([0-9]{1,2})\s*\]')
        then 'passage:' || regexp_extract(ink, '\[\s*([0-9]{1,2})\s*[~\-–—～]\s*([0-9]{1,2})\s*\]', 1)::int || '-' || regexp_extract(ink, '\[\s*([0-9]{1,2})\s*[~\-–—～]\s*([0-9]{1,2})\s*\]', 2)::int
        else 'passage:unknown' end
      when kind = 'question' then case when regexp_matches(s, '^\s*#([a-jA-J]+)4\b') then 'question:' || translate(lower(regexp_extract(s, '^\s*#([a-jA-J]+)4\b', 1)), 'abcdefghij', '1234567890')::int
        when regexp_matches(ink, '^\s*([0-9]{1,2})\s*[\.．。]') then 'question:' || regexp_extract(ink, '^\s*([0-9]{1,2})\s*[\.．。]', 1)::int else 'question:unknown' end end as key
  from vk
), vs as (select *, sum(case when kind in ('passage_group', 'question') then 1 else 0 end) over (partition by doc_id order by global_index rows unbounded preceding)::bigint as seg_no from vy),
sg0 as (
  select doc_id, seg_no, max(key) as key, max(case when kind in ('passage_group', 'question') then kind end) as kind, max(case when kind not in ('blank', 'separator') then 1 else 0 end) as useful,
    coalesce(string_agg(case when regexp_replace(ink, '^\s+|\s+$', '', 'g') <> '' then ink end, chr(10) order by global_index), '') as ink_text, string_agg(raw_ascii, chr(10) order by global_index) as ascii_text
  from vs group by doc_id, seg_no
), sg1 as (
  select *, regexp_matches(ink_text, '안내|수고|점역') or not (regexp_matches(ink_text, '\[\s*[0-9]{1,2}\s*[~\-–—～]\s*[0-9]{1,2}\s*\]|다음.+(?:물음|발표|글|토의)') or regexp_matches(ink_text, '^\s*([0-9]{1,2})\s*[\.．。]')
    or regexp_matches(ascii_text, '82#([a-jA-J]+)`9#([a-jA-J]+);0') or regexp_matches(ascii_text, '^\s*#([a-jA-J]+)4\b')) as guidance
  from sg0 where kind is not null or (useful = 1 and trim(ink_text) <> '')
), sg as (select doc_id, seg_no, coalesce(key, case when guidance then 'guidance:preamble' else 'preamble' end) as key, coalesce(kind, case when guidance then 'guidance' else 'preamble' end) as kind, ink_text, ascii_text from sg1)"""


def reference_segments(segments: DataFrame) -> DataFrame:
    """Segments as another edition has them: some under other keys, some with a tail of letters that occur nowhere
    else, so that their similarity is known."""
    size = "length(regexp_replace(ink_text, '[^a-z]', ''))"
    key = "if(kind in ('passage_group', 'question') and key rlike '[38]$', concat(key, '99'), key)"
    tail = f"case seg_no % 3 when 1 then repeat('ㅋ', int({size} div 2)) when 2 then repeat('ㅋ', 2 * {size}) else '' end"
    return segments.selectExpr("doc_id", "seg_no", f"{key} as key", "kind", f"concat(ink_text, {tail}) as ink_text", "ascii_text")


OTHER_SEGMENTS = r""",
so as (
  select doc_id, seg_no, case when kind in ('passage_group', 'question') and regexp_matches(key, '[38]$') then key || '99' else key end as key, kind,
    ink_text || case seg_no % 3 when 1 then repeat('ㅋ', (length(regexp_replace(ink_text, '[^a-z]', '', 'g')) // 2)::int) when 2 then repeat('ㅋ', (2 * length(regexp_replace(ink_text, '[^a-z]', '', 'g')))::int) else '' end as ink_text
  from sg
), na as (select *, row_number() over (partition by doc_id, key order by seg_no desc) as rn from sg where kind in ('passage_group', 'question')),
nb as (select *, row_number() over (partition by doc_id, key order by seg_no desc) as rn from so where kind in ('passage_group', 'question')),
a as (select doc_id, key, ink_text, NORM(ink_text) as t from na where rn = 1), b as (select doc_id, key, ink_text, NORM(ink_text) as t from nb where rn = 1),
j as (
  select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.key, b.key) as key, coalesce(a.ink_text, '') as generated_ink, coalesce(b.ink_text, '') as reference_ink, a.key is not null as ina, b.key is not null as inb,
    case when a.key is null or b.key is null then 0 when a.t = b.t then 1 when a.t = '' or b.t = '' then 0 else 2.0::double * length(a.t) / (length(a.t) + length(b.t)) end as score
  from a full join b on a.doc_id = b.doc_id and a.key = b.key
), sd as (
  select doc_id, case when not inb then 'missing_in_reference' when not ina then 'missing_in_generated' when score >= 0.72 then 'aligned_ok' else 'content_mismatch' end as classification, key, score, generated_ink, reference_ink from j
  union all select doc_id, 'expected_guidance', key, 0, '', ink_text from so where kind = 'guidance'
)""".replace("NORM(ink_text)", "translate(regexp_replace(regexp_replace(lower(ink_text), '\\s+', '', 'g'), '[·.?!,;:''\"\\[\\]()<>〈〉【】]', '', 'g'), '～—–', '~--')")


def annotations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines without tags, and two annotations for line doc_id mod 5 of every labelled document."""
    rows = lines(spark, sf_dir).selectExpr("doc_id", "n as global_index", "page_index", "line_index", "cast(array() as array<string>) as tags", "cast(null as string) as notes", "if(n % 3 = 0, array('Body'), cast(array() as array<string>)) as candidate_tags")
    notes = table(spark, sf_dir, "labels").selectExpr("doc_id", "explode(array(0, 1)) as nth", "quality", "toxic").selectExpr(
        "doc_id", "nth", "int((doc_id + if(quality = 1, 0, nth)) % 5) as global_index", "if(quality = 1, array('Good', concat('n', nth)), cast(array() as array<string>)) as tags", "if(toxic = 1, concat('note ', nth), null) as notes")
    return rows, notes


ANNOTATIONS = LINES + """,
an as (
  select doc_id, nth, ((doc_id + case when quality = 1 then 0 else nth end) % 5)::int as global_index, case when quality = 1 then 'Good,n' || nth else '' end as tags, case when toxic = 1 then 'note ' || nth end as notes
  from (select *, unnest([0, 1]) as nth from labels)
), la as (select doc_id, global_index, last(tags order by nth) as tags, max_by(coalesce(notes, ''), nth) as notes0 from an group by doc_id, global_index),
ap as (
  select l.doc_id, l.n as global_index, l.page_index, l.line_index, coalesce(la.tags, '') as tags, nullif(la.notes0, '') as notes, case when l.n % 3 = 0 then 'Body' else '' end as candidate_tags
  from l left join la on l.doc_id = la.doc_id and l.n = la.global_index
)"""
