"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

from ..functions.text import CHAPTER, CJK, SPACE
from .fixtures import (
    BOOK, BOOK_HEAD, CLASS, CODE_C, CODE_HASH, DOCX_COLUMNS, DOCX_HEAD, EXT, EXTENSION_LIST, FONT_HEAD, MD, NAME, OCR_COLUMNS, OCR_HEAD, PDF_COLUMNS, PDF_HEAD,
    PROMPT_CONTENT, RTF_HEAD, RTF_PIECE, STYLE, TOC_PARTS, TOC_Y, TXT, XML_PIECE, case_of,
)

W = "over (partition by doc_id order by pos rows between unbounded preceding and current row)"
WB = "over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding)"
WO = "over (partition by doc_id order by pos)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


DOC_LINES = """raw_lines as (select doc_id, generate_subscripts(ls, 1) - 1 as pos, unnest(ls) as line
  from (select doc_id, string_split(text, chr(10)) as ls from documents))"""


def headed(head: str, where: str = "true") -> str:
    """Headings at even positions, whole lines at odd ones."""
    return f"""lines0 as (select doc_id, generate_subscripts(ls, 1) - 1 as pos, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)),
lines1 as (select doc_id, pos, {head} as head, line from lines0 where {where}),
raw_lines as (select doc_id, pos * 2 as pos, head as line from lines1 where head is not null union all select doc_id, pos * 2 + 1, line from lines1)"""


def lines(marks) -> str:
    return f"{DOC_LINES},\nlines as (select doc_id, pos, {case_of(marks)} as line from raw_lines)"


_TXT_STATE = f"""{lines(TXT)},
f1 as (select doc_id, pos, line, {strip("line")} as s from lines),
f2 as (select *, (s = '```')::int as bare, (s like '```_%')::int as info from f1),
f3 as (select *, sum(bare) {W} as nb from f2),
f4 as (select *, last_value(case when info = 1 then nb end ignore nulls) {W} as base, max(info) {W} as seen from f3),
f5 as (select doc_id, pos, line, s, bare, info, (case when seen = 1 then (1 + nb - base) % 2 else nb % 2 end)::int as after from f4),
state as (select *, coalesce(lag(after) {WO}, 0) as before from f5)"""
_ATX = rf"^(#{{1,6}})[{SPACE}]+(.+)$"
_ITEM = rf"^([-*+]|[0-9]+[.)])[{SPACE}]+(.+)$"
_TXT_CLS = f"""{_TXT_STATE},
c1 as (select *, case when before = 1 and bare = 1 then 'Z' when before = 1 then 'C' when bare = 1 or info = 1 then 'O'
    when s = '' then 'B' when regexp_matches(s, '{_ATX}') then 'H'
    when regexp_matches(s, '{_ITEM}') then case when s[1] in ('-', '*') then 'L' else 'A' end
    when s[1] = '>' then 'Q' when regexp_matches(s, '{CHAPTER}') then 'H' when s[1] in ('#', '-', '*') then 'D' else 'P' end as raw from state),
c2 as (select *, last_value(case when raw <> 'A' then raw end ignore nulls) {WB} as known from c1),
cls as (select *, case when raw <> 'A' then raw when known = 'P' then 'P' else 'L' end as cls from c2)"""
_TXT_BLOCKS = f"""{_TXT_CLS},
b1 as (select *, lag(cls) {WO} as prev, last_value(case when cls <> 'B' then cls end ignore nulls) {WB} as prev_full from cls),
b2 as (select *, sum(case when cls in ('O', 'H') then 1 when cls in ('L', 'Q') then (prev_full is distinct from cls)::int
    when cls = 'P' then (prev is distinct from cls)::int else 0 end) {W} as blk from b1),
b3 as (select doc_id, blk, min(pos) as pos, min_by(cls, pos) as kind, min_by(s, pos) as head,
    string_agg(line, chr(10) order by pos) filter (where cls = 'C') as code, string_agg(s, ' ' order by pos) filter (where cls = 'P') as para,
    string_agg({strip("s[2:]")}, chr(10) order by pos) filter (where cls = 'Q') as quote,
    list(regexp_extract(s, '{_ITEM}', 2) order by pos) filter (where cls = 'L') as items, max_by(regexp_matches(s, '^[0-9]'), pos) as ordered
  from b2 where cls not in ('B', 'D') group by doc_id, blk),
blocks as (select doc_id, pos, case kind when 'O' then 'code' when 'P' then 'paragraph' when 'Q' then 'quote' when 'L' then 'list' else 'heading' end as type,
    case kind when 'O' then coalesce(code, '') when 'P' then para when 'Q' then quote
      when 'L' then array_to_string(list_transform(items, lambda x: (case when ordered then '1. ' else '- ' end) || x), chr(10))
      else case when regexp_matches(head, '{_ATX}') then regexp_extract(head, '{_ATX}', 2) else head end end as text,
    (case when kind = 'H' then case when regexp_matches(head, '{_ATX}') then length(regexp_extract(head, '{_ATX}', 1)) else 1 end else 0 end)::int as level,
    case when kind = 'O' then nullif(regexp_extract(head, '^```([\\p{{L}}\\p{{N}}_]+)$', 1), '') end as language,
    case when kind = 'L' then ordered end as list_ordered, case when kind = 'L' then len(items) end as n_items from b3)"""


def chapters_of(blocks: str, boundary: str) -> str:
    return f"""{blocks},
s1 as (select *, sum(({boundary})::int) {W} as seg from blocks),
s2 as (select *, row_number() over (partition by doc_id, seg order by pos) = 1 and type = 'heading' as is_title from s1),
s3 as (select doc_id, seg, max(text) filter (where is_title) as title, coalesce(sum(length(text)) filter (where not is_title), 0)::bigint as word_count,
    count(*) filter (where type = 'paragraph' and not is_title) as paragraph_count from s2 group by doc_id, seg),
s4 as (select *, row_number() over (partition by doc_id order by seg)::int as chapter_index from s3),
chapters as (select doc_id, chapter_index, coalesce(title, '章节 ' || chapter_index) as title, 1 as level, word_count, paragraph_count from s4)"""


_TXT_CHAPTERS = chapters_of(_TXT_BLOCKS, f"type = 'heading' and (level = 1 or regexp_matches(text, '{CHAPTER}'))")

ORACLE_SQL: dict[str, str] = {
    "txt_fence_state": f"with {_TXT_STATE} select doc_id, pos::int as pos, before, after from state",
    "txt_line_class": f"with {_TXT_CLS} select doc_id, pos::int as pos, s, cls from cls",
    "txt_blocks": f"with {_TXT_BLOCKS} select doc_id, pos::int as pos, type, text, level, language from blocks",
    "txt_lists": f"with {_TXT_BLOCKS} select doc_id, pos::int as pos, text, list_ordered, n_items::int as n_items from blocks where type = 'list'",
    "txt_quotes": f"with {_TXT_BLOCKS} select doc_id, pos::int as pos, text from blocks where type = 'quote'",
    "txt_paragraphs": f"with {_TXT_BLOCKS} select doc_id, pos::int as pos, text from blocks where type = 'paragraph'",
    "txt_chapters": f"with {_TXT_CHAPTERS} select * from chapters",
    "txt_doc_totals": f"with {_TXT_CHAPTERS} select doc_id, sum(word_count)::bigint as total_words, count(*) as total_chapters, sum(paragraph_count)::bigint as total_paragraphs from chapters group by doc_id",
}

_MD = f"""{DOC_LINES},
lines as (select doc_id, pos, case when doc_id % 7 = 0 then line else {case_of(MD)} end as line from raw_lines),
m1 as (select doc_id, pos, {strip("line")} as s from lines),
m2 as (select *, case when regexp_matches(s, '^#[{SPACE}]+.') then 1 when regexp_matches(s, '^##[{SPACE}]+.') then 2 else 0 end as level,
    regexp_matches(s, '^[-*+][{SPACE}]+.') as bullet, regexp_matches(s, '^[0-9]+[.][{SPACE}]+.') as number from m1 where s <> ''),
m3 as (select *, case when level > 0 then 'heading' when bullet or number then 'list' when s like '```%' then null when s[1] = '>' then 'quote' else 'paragraph' end as type from m2),
m4 as (select doc_id, pos, type, case when type = 'heading' then {strip("regexp_replace(s, '^#+', '')")} when bullet then {strip("s[2:]")}
    when number then {strip("regexp_replace(s, '^[0-9]+[.]', '')")} when type = 'quote' then {strip("s[2:]")} else s end as text,
    level, case when type = 'list' then not bullet end as list_ordered, sum((level = 1)::int) {W} as seg from m3 where type is not null)"""
_CSV = """data as (select p_size::bigint as doc_id, row_number() over (partition by p_size order by p_partkey) as row_no, p_partkey, p_name, p_brand, p_type from part),
rows as (select *, case when p_partkey % 13 = 0 then 'key=' || p_partkey || '; name=' || p_name when p_partkey % 29 = 0 then null
    else 'key=' || p_partkey || '; name=' || p_type || '; brand=' || p_brand end as line, count(*) over (partition by doc_id) as total from data)"""


def glued(piece: str, before: str, after: str) -> str:
    return f"""{DOC_LINES},
src as (select doc_id, '{before}' || string_agg({piece}, chr(10) order by pos) || '{after}' as content from raw_lines group by doc_id)"""


_RTF = f"""{glued(RTF_PIECE, RTF_HEAD, "}")},
r1 as (select doc_id, regexp_replace(content, '\\{{\\\\rtf1[^}}]*\\}}', '', 'g') as t from src),
r2 as (select doc_id, regexp_replace(t, '\\\\[a-z]+[0-9]*[{SPACE}]?', ' ', 'g') as t from r1),
rtf as (select doc_id, {strip(f"regexp_replace(regexp_replace(t, '[{{}}]', '', 'g'), '[{SPACE}]+', ' ', 'g')")} as line from r2)"""
_XML_TAGS = ["chapter", "section", "part", "book", "article", "title", "head", "body", "item", "entry"]
_XML = f"""{glued(XML_PIECE, '<?xml version="1.0"?>', "")},
x0 as (select doc_id, replace(content, '<?xml version="1.0"?>', '') as content from src),
x1 as ({" union all ".join(f"select doc_id, {k} as tag_no, '{t.upper()}' as tag, generate_subscripts(ms, 1) as m, unnest(ms) as part from (select doc_id, regexp_extract_all(content, '(?is)<{t}[^>]*>(.*?)</{t}>', 1) as ms from x0)" for k, t in enumerate(_XML_TAGS))}),
x2 as (select *, row_number() over (partition by doc_id order by tag_no, m)::int as chapter_index, {strip(f"regexp_replace(regexp_replace(part, '<[^>]+>', ' ', 'g'), '[{SPACE}]+', ' ', 'g')")} as text from x1),
x3 as (select doc_id, chapter_index, tag || ': ' || text[1:50] as title, text from x2 where text <> ''),
x4 as (select * from x3 union all
  select doc_id, 1, 'XML内容', {strip(f"regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '[{SPACE}]+', chr(10), 'g')")} from x0 where doc_id not in (select doc_id from x3))"""


def _runs(pieces: str) -> str:
    return f"""{pieces},
k1 as (select *, sum(flush::int) {W} as run from pieces)
select doc_id, min(pos)::int as pos, string_agg(piece, ' ' order by pos) as comment from k1 where piece is not null group by doc_id, run"""


_SLASH = f"""{lines(CODE_C)},
a1 as (select doc_id, pos, {strip("line")} as s from lines),
a2 as (select *, case when s like '//%' then 'line' when s like '/*%' then 'open' when s like '%*/' then 'close' end as kind, {strip("s[3:]")} as rest from a1),
a3 as (select *, coalesce(last_value(case kind when 'open' then 1 when 'close' then 0 end ignore nulls) {WB}, 0) = 1 as inside from a2),
pieces as (select doc_id, pos, case when kind = 'line' then nullif(rest, '') when kind = 'open' then case when rest not like '*%' then nullif(rest, '') end
    when kind is null and inside then nullif({strip("ltrim(s, '*')")}, '') end as piece, coalesce(kind = 'close', not inside) as flush from a3)"""
_HASH = f"""{lines(CODE_HASH)},
a1 as (select doc_id, pos, {strip("line")} as s from lines),
pieces as (select doc_id, pos, case when s[1] = '#' and {strip("s[2:]")} <> '' and {strip("s[2:]")} not like '===%' and {strip("s[2:]")} not like '---%' then {strip("s[2:]")} end as piece,
    s[1] <> '#' as flush from a1)"""
_LANG = "case ext when 'py' then 'python' when 'kt' then 'kotlin' when 'yml' then 'yaml' when 'cs' then 'csharp' when 'sh' then 'bash' else ext end"

ORACLE_SQL |= {
    "md_blocks": f"with {_MD} select doc_id, pos::int as pos, type, text, level, list_ordered, seg::bigint as seg from m4",
    "md_chapters": f"with {_MD} select doc_id, seg::int as chapter_index, min_by(text, pos) as title, sum(length(text))::bigint as word_count, count(*) filter (where type = 'paragraph') as paragraph_count from m4 where seg >= 1 group by doc_id, seg",
    "md_whole": f"with {_MD} select doc_id, 1 as chapter_index, '全文' as title, length(text)::bigint as word_count, len(string_split(text, chr(10) || chr(10)))::bigint as paragraph_count from documents where doc_id not in (select doc_id from m4 where level = 1)",
    "csv_header": "select distinct p_size::bigint as doc_id, 1 as chapter_index, '表头信息' as title, '列数: 4' || chr(10) || '列名: key, name, brand, name' as text, length('列数: 4' || chr(10) || '列名: key, name, brand, name')::bigint as word_count, 1::bigint as paragraph_count from part",
    "csv_chunks": f"""with {_CSV}, chunks as (select doc_id, ((row_no - 1) // 10)::int as chunk, max(total) as total, count(*) as n, coalesce(string_agg(line, chr(10) order by row_no), '') as text from rows group by all)
select doc_id, chunk + 2 as chapter_index, '数据行 ' || (chunk * 10 + 1) || '-' || least(chunk * 10 + 10, total) as title, '表格数据 (' || n || ' 行)' as caption, text, length(text)::bigint as word_count, n as paragraph_count from chunks""",
    "json_keys": "select event_id as doc_id, 1 as chapter_index, 'k' as title, json_extract_string(props, '$.k') as text, length(json_extract_string(props, '$.k'))::bigint as word_count from events",
    "json_chapters": """with c as (
select n_nationkey::bigint as doc_id, i as chapter_index, ['name', 'ok', 'none', 'tags', 'deep'][i] as title, [n_name, 'True', 'None', '[1] a' || chr(10) || '[2] ' || n_nationkey, 'x: 1.5' || chr(10) || 'y: z'][i] as text, 'paragraph' as type from nation, (select unnest([1, 2, 3, 4, 5]) as i)
union all select r_regionkey + 100, i, [r_name, '第2项', '第3项'][i], ['title: ' || r_name, 'a: 1', '7'][i], 'paragraph' from region, (select unnest([1, 2, 3]) as i)
union all select r_regionkey + 200, i, [r_name, '第2项'][i], ['topic: ' || r_name, 'b: ' || r_regionkey][i], 'paragraph' from region, (select unnest([1, 2]) as i)
union all select r_regionkey + 300, 1, 'JSON内容', '{broken ' || r_name, 'code' from region)
select *, length(text)::bigint as word_count, 1::bigint as paragraph_count from c""",
    "xml_tags": f"with {_XML} select *, length(text)::bigint as word_count from x4",
    "rtf_strip": f"with {_RTF} select doc_id, line as text from rtf",
    "rtf_chapters": f"""with {_RTF}, h as (select *, regexp_matches(line, '(?i)^(CHAPTER|SECTION|PART|第[一二三四五六七八九十0-9]+章)') as headed from rtf)
select doc_id, 1 as chapter_index, case when headed then line else '全文' end as title, case when headed then 0 else length(line) end::bigint as word_count, case when headed then 0 else 1 end::bigint as paragraph_count from h""",
    "code_comments_hash": f"with {_runs(_HASH)}",
    "code_comments_c": f"with {_runs(_SLASH)}",
    "code_comments_markup": f"""with l as (select page_id as doc_id, generate_subscripts(ls, 1) - 1 as pos, unnest(ls) as line from (select page_id, string_split(html, chr(10)) as ls from pages)),
s as (select doc_id, pos, {strip("line")} as s from l), t as (select doc_id, pos, {strip("case when instr(s, '-->') > 0 then substring(s, instr(s, '<!--') + 4, greatest(instr(s, '-->') - instr(s, '<!--') - 4, 0)) else substring(s, instr(s, '<!--') + 4) end")} as comment from s where instr(s, '<!--') > 0)
select doc_id, pos::int as pos, comment from t where comment <> ''""",
    "code_documents": f"""with d as (select doc_id, {EXT} as ext, text from documents)
select doc_id, '代码: f' || doc_id || '.' || ext as title, '文件: f' || doc_id || '.' || ext || chr(10) || '语言: ' || {_LANG} as info, {_LANG} as language, length(text)::bigint as word_count,
  len(list_filter(string_split(text, chr(10)), lambda x: {strip("x")} <> ''))::bigint as paragraph_count from d""",
}

_LABEL = "^(【[章节篇卷部]】|\\[[章节篇卷部]\\]|[（(][章节篇卷部][)）])$"
_NOTE = f"(?i)^(注释[{SPACE}]*[-—–:：]|Notes?$|注释$|注[{SPACE}]*[0-9]+|[0-9]+[{SPACE}]*注释)"


def measured(source: str) -> str:
    return f"""{source},
p1 as (select *, {strip("text")} as s, text like '%。' as period, (y0 + y1) / 2 < page_height * 0.06 or (y0 + y1) / 2 > page_height * (1 - 0.06) as margin,
    case when lag(page_num) {WO} = page_num then y0 - lag(y1) {WO} else 0 end as gb, case when lead(page_num) {WO} = page_num then lead(y0) {WO} - y1 else 0 end as ga from pdf),
p2 as (select *, greatest(gb, ga) > (y1 - y0) * 0.5 as loose, page_width - (x1 - x0) > page_width * 0.5 and greatest(gb, ga) > (y1 - y0) as apart,
    regexp_matches(s, '{_LABEL}') as label, regexp_matches(s, '{_NOTE}') as note, length(s) < 30 and margin as short_margin from p1),
sizes as (select doc_id, round_even(font_size, 0)::double as size, count(*) as n, min(pos) as first from pdf group by 1, 2),
bases as (select doc_id, size as base from (select *, row_number() over (partition by doc_id order by n desc, first) as r from sizes) where r = 1),
based as (select p2.*, base, font_size / base as ratio, font_size / base between 0.9 and 1.1 as body_sized from p2 join bases using (doc_id))"""


_PDF = measured(f"""{headed(PDF_HEAD)},
pdf0 as (select *, {PDF_COLUMNS[0][1]} as page_num, {PDF_COLUMNS[1][1]} as font_size, {PDF_COLUMNS[2][1]} as text from raw_lines),
pdf as (select doc_id, pos, {", ".join(f"{e} as {n}" for n, e in PDF_COLUMNS[3:])}, page_num, font_size, text from pdf0)""")
_CAND = f"""{_PDF},
cand as (select * from based where length(s) >= 2 and not short_margin and not label and not period and ratio > 1 and case when ratio >= 1.39 then loose else apart end)"""
_THR = f"""{_CAND},
cs as (select doc_id, font_size, count(*) as n, min(pos) as first from cand group by 1, 2),
cr as (select *, row_number() over (partition by doc_id order by n desc, first) as r from cs),
means as (select doc_id, sum(font_size * n) / sum(n) as mean from cr where r > 1 group by 1),
thr as (select doc_id, coalesce(mean, base * 1.4) as level1, case when mean is null then base * 1.1 else greatest(mean * 0.8, base * 1.1) end as level2 from bases left join means using (doc_id))"""
_NEXT19 = "over (partition by doc_id order by pos rows between 1 following and 19 following)"
_NEXT29 = "over (partition by doc_id order by pos rows between 1 following and 29 following)"
_NEXT9 = "over (partition by doc_id order by pos rows between 1 following and 9 following)"
_X0 = f"first_value(case when body_sized and length(text) > 10 then x0 end ignore nulls) {_NEXT19}"
_CLASS = f"""{_THR},
q1 as (select based.*, level1, {_X0} as bx from based join thr using (doc_id)),
q2 as (select *, level1 - least(0.2, level1 * 0.01) as cut from q1),
q3 as (select *, case when length(s) < 2 or short_margin or label or note or period then 0 when font_size >= cut and loose then 1
    when font_size > base and font_size < cut and apart then case when bx is null or bx = 0 or abs(x0 - bx) > 10 then 2 when length(s) < 50 then 3 else 0 end else 0 end as level from q2),
classified as (select *, level in (2, 3) as as_body from q3)"""
_IND = f"""{_CLASS},
i1 as (select *, coalesce(first_value(case when body_sized and length(text) > 10 then true when level > 0 then false end ignore nulls) {_NEXT9}, false) as soon,
    level = 0 and ((body_sized and length(text) > 10) or (period and length(text) > 5)) as says from classified),
i2 as (select *, first_value(case when says then true when level = 3 and soon then true when level = 2 then false end ignore nulls) {_NEXT29} as f1,
    first_value(case when says then true when level = 3 and soon then true end ignore nulls) {_NEXT29} as f2, first_value(case when says then true end ignore nulls) {_NEXT29} as f3 from i1),
ind as (select *, case when level > 0 then coalesce(case level when 1 then f1 when 2 then f2 else f3 end, false) end as independent from i2)"""
_MERGE = f"""{_IND},
h1 as (select *, level = 1 and not independent as hungry from ind where level > 0),
h2 as (select *, coalesce(sum((not hungry)::int) {WB}, 0) as grp from h1),
h3 as (select *, row_number() over (partition by doc_id, grp, hungry order by pos) as nth, lead(text) {WO} as next_text from h2),
h4 as (select *, hungry and nth % 2 = 1 and next_text is not null as leads from h3),
h5 as (select *, coalesce(lag(leads) {WO}, false) as eaten from h4),
merged as (select doc_id, pos, level, case when leads then text || ' - ' || next_text else text end as title, independent or leads as independent, as_body and not leads as as_body from h5 where not eaten)"""
_ENDS = "ratio >= 1.4 and length(s) < 50 and not regexp_matches(s, '[.。!！?？]$') and not note"
_IMPRINT = f"(regexp_matches(s, 'http://|https://|www[.]|版权所有|仅供学习|严禁商业|不得转载|翻版必究') or regexp_matches(s, '^[0-9]+$|^[-{SPACE}]*[0-9]+[-{SPACE}/]*$'))"
_PDF_CHAPTERS = f"""{_MERGE},
n1 as (select ind.*, m.title, m.independent as m_ind, m.as_body as m_body, m.pos is not null as head, coalesce(last_value(case when note then true when {_ENDS} then false end ignore nulls) over (partition by ind.doc_id order by ind.pos rows between unbounded preceding and current row), false) as in_note
  from ind left join merged m on m.doc_id = ind.doc_id and m.pos = ind.pos),
n2 as (select *, (head and not m_body) or note as bound from n1),
n3 as (select *, sum(coalesce(bound, false)::int) {W} as seg, coalesce(bound and not note and m_ind and not in_note and not regexp_matches(title, '{_NOTE}'), false) as opens,
    not in_note and not short_margin and not {_IMPRINT} as shown, not head and (body_sized or period or ratio < 1.15) as plain from n2),
n4 as (select doc_id, seg, max(title) filter (where opens) as title, max(level) filter (where opens) as level, coalesce(sum(length(replace(replace(text, ' ', ''), chr(10), ''))) filter (where shown), 0)::bigint as word_count,
    count(*) filter (where shown and plain and not opens) as paragraph_count from n3 group by 1, 2 having bool_or(opens))"""
_TOC_LINES = f"""{DOC_LINES},
t0 as ({" union all ".join(f"select doc_id, {k} as k, {n} as n, {page} as page_num, cast({size} as double) as font_size, {text} as text from raw_lines where {where}" for k, n, page, size, text, where in TOC_PARTS)}),
t1 as (select doc_id, row_number() over (partition by doc_id order by k, n) - 1 as pos, page_num, font_size, text from t0),
pdf as (select *, 72.0::double as x0, 300.0::double as x1, {TOC_Y} as y0, {TOC_Y} + 14 as y1, 600.0::double as page_width, 780.0::double as page_height from t1)"""
_TOC = f"""{_TOC_LINES},
u1 as (select *, {strip("text")} as s from pdf),
u2 as (select doc_id, min(pos) as sp from u1 where s = '目录' and font_size >= 20 group by 1),
u3 as (select u1.*, st.page_num as sp_page from u1 join u2 on u1.doc_id = u2.doc_id and u1.pos > u2.sp join u1 st on st.doc_id = u2.doc_id and st.pos = u2.sp),
u4 as (select *, max((page_num > sp_page + 1)::int) {W} as gone from u3),
u5 as (select *, case when font_size >= 19 and contains(s, '第') and contains(s, '篇') then 'part' when font_size >= 19 then 'chapter' else 'section' end as type from u4 where gone = 0 and s <> '' and s <> '目录' and length(s) < 50 and font_size >= 14),
toc as (select doc_id, (row_number() {WO} - 1)::int as toc_pos, s as title, case when type = 'section' then 2 else 1 end as level, type, case when type <> 'part' then last_value(case when type = 'part' then s end ignore nulls) {W} end as parent, sp_page + 2 as from_page from u5)"""
_GLUE = ", ".join(f"""case when {" and ".join(f"coalesce(lead(page_num, {j}) {WO}, -1) = page_num" for j in range(1, k + 1))} then translate(s || {" || ".join(f"coalesce(lead(s, {j}) {WO}, '')" for j in range(1, k + 1))}, ' 　', '') end as g{k}""" for k in range(1, 5))
_TOC_MATCH = f"""{_TOC},
v1 as (select *, count(*) over (partition by doc_id) as n, {_GLUE} from u1),
v2 as (select t.doc_id, t.toc_pos, min(v1.pos)::int as idx from toc t join v1 on v1.doc_id = t.doc_id and v1.page_num >= t.from_page and t.type <> 'part'
  and (v1.s = t.title or (starts_with(t.title, v1.s) and length(v1.s) >= 3 and ({" or ".join(f"coalesce(contains(g{k}, translate(t.title, ' 　', '')), false)" for k in range(1, 5))})))
  and not (t.type = 'section' and v1.pos / v1.n >= 0.95) group by 1, 2),
matched as (select t.*, idx from toc t left join v2 using (doc_id, toc_pos))"""
ORACLE_SQL |= {
    "pdf_base_size": f"with {_PDF} select doc_id, base from bases",
    "pdf_candidates": f"with {_CAND} select doc_id, pos::int as pos, text, round(ratio, 6) as ratio from cand",
    "pdf_thresholds": f"with {_THR} select doc_id, round(level1, 6) as level1, round(level2, 6) as level2 from thr",
    "pdf_body_x0": f"with {_PDF} select doc_id, pos::int as pos, {_X0} as body_x0 from based",
    "pdf_header_footer": f"with {_PDF} select doc_id, pos::int as pos, margin, label, note, {_IMPRINT} as imprint, loose, apart from p2",
    "pdf_classify": f"with {_CLASS} select doc_id, pos::int as pos, level, as_body from classified",
    "pdf_independence": f"with {_IND} select doc_id, pos::int as pos, level, independent from ind where level > 0",
    "pdf_merge": f"with {_MERGE} select doc_id, pos::int as pos, level, title, independent, as_body from merged",
    "pdf_notes": f"with {_PDF} select doc_id, pos::int as pos, coalesce(last_value(case when note then true when {_ENDS} then false end ignore nulls) {W}, false) as in_note from based",
    "pdf_chapters": f"with {_PDF_CHAPTERS} select doc_id, (row_number() over (partition by doc_id order by seg))::int as chapter_index, title, level, word_count, paragraph_count from n4",
    "pdf_lines_from_spans": f"""with {DOC_LINES}, w as (select doc_id, pos, generate_subscripts(ws, 1) - 1 as k, unnest(ws) as t0 from (select doc_id, pos, string_split(line, ' ') as ws from raw_lines)),
w2 as (select *, {strip("t0")} as t from w)
select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as pos, string_agg(t, '' order by k) as text, round(avg(10.0 + k % 4), 6)::double as font_size, min_by('f' || (k % 3), k) as font_name,
  min(k * 10.0)::double as x0, max(k * 10.0 + length(t0))::double as x1, max(20.0 + k % 2)::double as y1, string_agg(t, '' order by k) like '%。' as ends_with_period from w2 where t <> '' group by doc_id, pos""",
    "pdf_toc": f"with {_TOC} select doc_id, toc_pos, title, level, type, parent from toc",
    "pdf_toc_match": f"with {_TOC_MATCH} select doc_id, toc_pos, title, type, idx as index from matched",
    "pdf_toc_chapters": f"""with {measured(_TOC_MATCH)},
y1 as (select *, count(idx) over (partition by doc_id) as found from matched),
y2 as (select *, (row_number() over (partition by doc_id order by toc_pos))::int as chapter_index, lead(idx) over (partition by doc_id order by toc_pos) as stop from y1 where found >= 3 and idx is not null),
y3 as (select y2.doc_id, chapter_index, sum(length(replace(replace(text, ' ', ''), chr(10), '')))::bigint as wc, count(*) filter (where b.pos > idx and (body_sized or period or ratio < 1.15)) as pc
  from y2 join based b on b.doc_id = y2.doc_id and b.pos >= idx and (stop is null or b.pos < stop) group by 1, 2)
select doc_id, chapter_index, title, level, coalesce(wc, 0)::bigint as word_count, coalesce(pc, 0)::bigint as paragraph_count from y2 left join y3 using (doc_id, chapter_index)""",
}

_NUM = "0-9一二三四五六七八九十百千万"
_DOCX = f"""{headed(DOCX_HEAD, "line <> ''")},
paras as (select doc_id, pos, {", ".join(f"{e} as {n}" for n, e in DOCX_COLUMNS)} from raw_lines),
sz as (select doc_id, font_size, row_number() over (partition by doc_id order by font_size, pos) - 1 as i, count(*) over (partition by doc_id) as n from paras where font_size <> 0),
st as (select doc_id, min(font_size) as min_size, max(font_size) as max_size, avg(font_size) as mean_size, max(font_size) filter (where i = n // 4) as q1_size,
    max(font_size) filter (where i = n // 2) as median_size, max(font_size) filter (where i = 3 * n // 4) as q3_size from sz group by 1),
stats as (select d.doc_id, min_size, max_size, mean_size, q1_size, coalesce(median_size, 12) as median_size, coalesce(q3_size, 14) as q3_size from (select distinct doc_id from paras) d left join st using (doc_id)),
d1 as (select p.*, median_size, q3_size, coalesce(font_size, median_size) as fs, case when lower(style_name) like '%heading%' or style_name like '%标题%' then coalesce(try_cast(regexp_extract(style_name, '[0-9]+') as int), 1) else 0 end as style_level from paras p join stats using (doc_id)),
d2 as (select *, case when style_level in (1, 2) then true when fs > q3_size * 1.15 and length(text) < 50 then is_centered or is_bold
    when regexp_matches(text, '(?i)^(第[{_NUM}]+[章节篇回]|(Chapter|Part|Section)[{SPACE}]+[0-9]+)') and length(text) < 60 then style_level > 0 or fs > median_size * 1.1 else false end as is_chapter_title from d1),
docx as (select *, case when is_chapter_title then 0 when style_level >= 3 then style_level
    when regexp_matches(text, '^([0-9]{{1,3}}[.、{SPACE}]|[0-9]{{2,3}}[{SPACE}]|[（(][0-9]{{1,3}}[)）]|[\\x{{4e00}}-\\x{{9fa5}}]{{1,3}}[、.{SPACE}]|[（(][\\x{{4e00}}-\\x{{9fa5}}]{{1,3}}[)）])') then case when fs between median_size * 1.05 and median_size * 1.3 then 2 else 0 end
    when is_bold and length(text) < 40 then 3 else 0 end as subheading_level from d2)"""
_DOCX_CH = f"""{_DOCX},
e1 as (select *, sum(is_chapter_title::int) {W} as seg from docx),
e2 as (select *, max(seg) over (partition by doc_id) > 0 as has from e1),
e3 as (select *, row_number() over (partition by doc_id, seg order by pos) as rn, count(*) over (partition by doc_id, seg) as size from e2 where not has or seg >= 1),
e4 as (select doc_id, seg, min_by(text, pos)[1:case when bool_or(has) then 100 else 50 end] as title, coalesce(sum(length(text)) filter (where rn > 1 or size = 1), 0)::bigint as word_count,
    count(*) filter (where (rn > 1 or size = 1) and subheading_level = 0) as paragraph_count from e3 group by 1, 2)"""
_OCR = f"""{headed(OCR_HEAD)},
ocr0 as (select doc_id, pos, {", ".join(f"{e} as {n}" for n, e in OCR_COLUMNS)} from raw_lines),
ocr1 as (select *, {strip("text")} as s from ocr0 where text <> '' and confidence > 0.5),
ocr2 as (select doc_id, pos, text, s, case when length(s) < 30 and regexp_matches(s, '(?i)^(第[{_NUM}]+[章节篇回]|(Chapter|Part)[{SPACE}]+[0-9]+|[0-9一二三四五六七八九十]+[、.{SPACE}]|摘要|前言|引言|结论|总结|附录)') then 'heading'
    when regexp_matches(s, '^[•*0-9-]+[.)]?[{SPACE}]') then 'list' when s[1] in ('>', '「') then 'quote' else 'paragraph' end as type,
    case when regexp_matches(s, '^(第[{_NUM}]+[章节篇回]|(?i:Chapter)[{SPACE}]+[0-9]+)') then 1 when regexp_matches(s, '^[0-9一二三四五六七八九十]+[、.{SPACE}]') then 2 when regexp_matches(s, '^[（(][0-9一二三四五六七八九十]+[)）]') then 3 else 0 end as level from ocr1),
blocks as (select * from ocr2)"""
_OCR_CH = chapters_of(_OCR, f"type = 'heading' and (regexp_matches(s, '{CHAPTER}') or regexp_matches(s, '^([0-9]{{1,3}}[.、{SPACE}]+|[0-9]{{2,3}}[{SPACE}]+)[\\x{{4e00}}-\\x{{9fa5}}]'))")


def count_re(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def filename(x: str) -> str:
    reserved = '[<>:"/\\\\|?*]'
    clean = f"regexp_replace(regexp_replace(regexp_replace({x}, '[\\r\\n]', ' ', 'g'), '{reserved}', '_', 'g'), '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g')"
    return f"coalesce(nullif(trim({clean}, '. ')[1:80], ''), 'untitled')"


_RENDER = f"""{_TXT_BLOCKS},
g1 as (select doc_id, pos, case when type = 'heading' then repeat('#', least(6, greatest(1, level))) || ' ' else '' end || {strip("text")} as part, {strip("text")} as t from blocks),
g2 as (select doc_id, string_agg(part, chr(10) || chr(10) order by pos) filter (where t <> '') as body from g1 group by 1),
g3 as (select doc_id, (doc_id % 5 + 1)::int as n, string_split(text, chr(10))[1] as title, (doc_id % 4 + 1)::int as level, case when doc_id % 2 = 0 then '2.1' end as path, coalesce(body, '') as body from documents left join g2 using (doc_id)),
g4 as (select *, coalesce(nullif(title, ''), '第' || n || '章') as shown, case level when 1 then '【章】' when 2 then '【节】' when 3 then '【小节】' else '【层级' || level || '】' end as mark from g3)"""
_PROMPT = f"""files as (select doc_id || '_' || source as folder, source, {PROMPT_CONTENT} as content from documents),
pb as (select *, case when len(string_split(content, '---')) >= 3 then {strip("string_split(content, '---')[3]")} else content end as body from files)"""
_HEADS = f"""{_PROMPT},
pl as (select folder, generate_subscripts(ls, 1) as pos, unnest(ls) as line from (select folder, string_split(body, chr(10)) as ls from pb)),
ph as (select folder, row_number() over (partition by folder order by pos) - 1 as i, length(regexp_extract(line, '{_ATX}', 1)) as level, regexp_extract(line, '{_ATX}', 2) as title from pl where regexp_matches(line, '{_ATX}')),
po as (select folder, count(*) as n_headers, string_agg(repeat('  ', (level - 1)::int) || repeat('#', level::int) || ' ' || title || chr(10), '' order by i) filter (where i < 15) as outline from ph group by 1)"""
_ROUTES = {"pdf": "pdf", "epub": "epub", "doc": "docx", "xhtml": "html", "md": "markdown", "jsonl": "json", "tab": "csv", "opml": "xml", "rtf": "rtf", "kts": "code", "txt": "txt"}

ORACLE_SQL |= {
    "docx_style_level": f"with {_DOCX} select doc_id, pos::int as pos, style_level from docx",
    "docx_stats": f"with {_DOCX} select doc_id, min_size, max_size, round(mean_size, 6) as mean_size, q1_size, median_size, q3_size from stats",
    "docx_classify": f"with {_DOCX} select doc_id, pos::int as pos, is_chapter_title, subheading_level from docx",
    "docx_chapters": f"with {_DOCX_CH} select doc_id, (row_number() over (partition by doc_id order by seg))::int as chapter_index, title, word_count, paragraph_count from e4",
    "docx_totals": f"with {_DOCX} select doc_id, sum(length(text))::bigint as total_words from paras group by 1",
    "docx_paragraphs": f"""with {DOC_LINES}, w as (select doc_id, pos, generate_subscripts(ws, 1) - 1 as k, unnest(ws) as t from (select doc_id, pos, string_split(line, ' ') as ws from raw_lines)),
g as (select doc_id, pos, {strip("string_agg(t || ' ', '' order by k)")} as text, round(avg(case when k % 3 > 0 then 10.0 + k % 4 end), 6)::double as font_size, bool_or(k = 4) as is_bold, false as is_italic,
  'f' || max(k) filter (where k % 2 = 0) as font_name, case when pos % 2 = 0 then 'center' else 'left' end as alignment, pos % 2 = 0 as is_centered from w group by doc_id, pos)
select doc_id, pos::int as pos, text, font_size, is_bold, is_italic, font_name, alignment, is_centered from g where text <> ''""",
    "ocr_filter": f"with {_OCR} select doc_id, pos::int as pos, text from ocr1",
    "ocr_classify": f"with {_OCR} select doc_id, pos::int as pos, type, level from ocr2",
    "ocr_chapters": f"with {_OCR_CH} select * from chapters",
    "ocr_results": f"with {_OCR} select doc_id, (row_number() {WO} - 1)::int as pos, (case when pos < 3 then 0 else 1 end)::int as page_num, text, (pos * 10)::double as x0, 100::double as y0, (pos * 10 + 9)::double as x1, 105::double as y1 from ocr1",
    "render_markdown": f"""with {_RENDER} select doc_id, repeat('#', level) || ' ' || shown || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**章节序号**：第' || n || '章  ' || chr(10) || '**章节层级**：' || level || ' ' || mark || '  ' || chr(10)
  || '**层级路径**：' || coalesce(path, n::varchar) || '  ' || chr(10) || '**字数统计**：' || length(body) || ' 字  ' || chr(10) || '**生成时间**：2025-01-01 00:00  ' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || coalesce(nullif(body, ''), '*（本章内容为空）*') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*leafspine*' as markdown, length(body)::bigint as word_count,
  ({count_re("body", CJK)} + {count_re("body", f"[^{SPACE}]+")})::bigint as display_count, replace(coalesce(path, n::varchar), '.', '_') || '_' || {filename("coalesce(nullif(title, ''), 'chapter_' || n)")} || '.md' as file_name from g4""",
    "safe_filename": f"""with d as (select doc_id, {NAME} as name from documents) select doc_id, {filename("name")} as file_name from d""",
    "hierarchy_path": """select 'r' || r_regionkey as chapter_id, (r_regionkey + 1)::varchar as hierarchy_path from region
union all select 'n' || n_nationkey, (n_regionkey + 1) || '.' || (n_nationkey + 1) from nation
union all select 's' || s_suppkey, (n_regionkey + 1) || '.' || (n_nationkey + 1) || '.' || s_suppkey from supplier join nation on s_nationkey = n_nationkey""",
    "prompt_folders": "select doc_id || '_' || source as folder, least(lang, source) || '.md' as file_name, doc_id::int as number from documents where doc_id % 7 <> 0",
    "prompt_body": f"with {_PROMPT} select folder, body, source as title, {count_re('body', CJK)}::bigint as n_cjk from pb",
    "prompt_headers": f"with {_HEADS} select folder, i::int as i, level::int as level, title from ph",
    "prompt_outline": f"with {_HEADS} select folder, coalesce(n_headers, 0) as n_headers, coalesce(outline, '') as outline from pb left join po using (folder)",
    "prompt_files": f"""with {_HEADS} select folder, source as title, {count_re('body', CJK)}::bigint as word_count, coalesce(n_headers, 0) as n_headers, '# 章节分析' || chr(10) || chr(10) || '章节：' || source || chr(10) || '字数：' || {count_re('body', CJK)} || chr(10) || '结构：' || chr(10) || coalesce(outline, '') || chr(10)
  || '正文：' || chr(10) || body[1:8000] || case when length(body) > 8000 then chr(10) || chr(10) || '...[内容过长，已截取前8000字符]' else '' end || chr(10) as prompt from pb left join po using (folder)""",
    "route_format": f"""with d as (select *, {EXTENSION_LIST}[doc_id % {len(EXTENSION_LIST)} + 1] as ext from documents)
select '/in/' || source || '/f.x' || doc_id || '.' || ext as path, 'f.x' || doc_id || '.' || ext as file_name, lower(ext) as file_format, n_chars::bigint as size,
  case lower(ext) {" ".join(f"when '{k}' then '{v}'" for k, v in _ROUTES.items())} end as reader from d""",
    "ocr_fallback": """with d as (select doc_id, case when doc_id % 2 = 0 then 'pdf' else 'txt' end as file_format, n_chars, lang, doc_id % 2 = 0 and n_chars < 1000 as used_ocr from documents)
select doc_id, file_format, case when used_ocr then case when doc_id % 3 <> 0 then n_chars * 2 end else n_chars end::bigint as total_words, case when used_ocr then case when doc_id % 3 <> 0 then 'ocr ' || lang end else lang end as title, used_ocr from d""",
}

_STOP = "版权|目录|contents|赞誉|推荐序|译者序|前言|序言|致谢|简介|介绍|导言|引言|后记|附录|参考文献|索引|关于作者|关于本书|献词|扉页|封面"
_END = "，。！？；：\"（）"


def title_ok(t: str) -> str:
    return f"(length({t}) between 3 and 100 and not contains('{_END}', {t}[-1]) and not regexp_matches(lower({t}), '{_STOP}'))"


_ZH = "一二三四五六七八九十百千0-9"
_PATTERNS = [
    (f"第[{_ZH}]+章[{SPACE}]*[:：]?[{SPACE}]*[^\\n]+", 1), ("第[一二三四五六七八九十0-9]+[章节篇卷集部]", 1), (f"Chapter[{SPACE}]*[0-9IVX]+[:：]?[{SPACE}]*[^\\n]+", 1), (f"Part[{SPACE}]*[0-9]+|Volume[{SPACE}]*[0-9IVX]+|Book[{SPACE}]*[0-9]+", 1),
    (f"^[0-9]{{1,2}}[.{SPACE}]+[^\\n]+", 2), (f"^[（(]?[0-9]{{1,2}}[)）]?[、.{SPACE}]+[^\\n]+", 2), (f"^[（(]?[一二三四五六七八九十百千]+[)）]?[、.{SPACE}]+[^\\n]+", 2),
]
_BOOK_TEXTS = f"""{lines(BOOK)}, texts as (select doc_id, string_agg(line, chr(10) order by pos) as text from lines group by 1),
found as ({" union all ".join(f"select doc_id, {k} as pattern, {level} as level, generate_subscripts(ms, 1) - 1 as nth, unnest(ms) as m, unnest(gs[1:len(ms)]) as g from (select doc_id, regexp_extract_all(text, '(?im){p}') as ms, string_split_regex(text, '(?im){p}') as gs from texts)" for k, (p, level) in enumerate(_PATTERNS))}),
hits as (select *, length(g) + coalesce(sum(length(g) + length(m)) over (partition by doc_id, pattern order by nth rows between unbounded preceding and 1 preceding), 0) as position from found)"""
_CANDS = f"""{headed(BOOK_HEAD)}, c0 as (select *, line as title, (pos % 3)::int as prio, 'f' || (pos % 2) as file_path from raw_lines),
c1 as (select *, row_number() over (partition by doc_id, prio order by file_path, pos % 7, pos) as rn from c0),
valid as (select * from c1 where (regexp_matches(title, '(?i)第[{_ZH}]+[章讲]|Chapter[{SPACE}]*[0-9]+|^[0-9]+[{SPACE}]+|^[0-9]+[.{SPACE}]') and pos % 4 < 3) or length(title) >= 50 or rn = 1)"""
_RANGES = """f as (select doc_id as d, doc_id // 50 as doc_id, lpad(doc_id::varchar, 8, '0') as file_path, text, lang, (row_number() over (partition by doc_id // 50 order by lpad(doc_id::varchar, 8, '0')) - 1)::int as idx from documents),
ch as (select f.doc_id, file_path, p as position, 'c' || p || lang as title, idx as file_idx from f, (select unnest([0, 5]) as p) where d % 3 = 0 and (p = 0 or d % 2 = 0)),
rg as (select *, coalesce(lead(file_idx) over (partition by doc_id order by file_path, position), 1073741824)::int as until from ch)"""
ORACLE_SQL |= {
    "html_title": f"select page_id, {strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title, length(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'))::int as n_chars from pages",
    "html_word_count": f"select doc_id, ({count_re("text || '中文'", CJK)} + {count_re("text", "[a-zA-Z]+")})::bigint as word_count from documents",
    "html_substance": f"""with d as (select doc_id, string_split(text, chr(10))[1] as t, text as x from documents),
r as (select doc_id, case when t <> '' and instr(x, t) > 0 then x[1:instr(x, t) - 1] || x[instr(x, t) + length(t):] else x end as rest from d) select doc_id, {count_re('rest', CJK)} > 3 or {count_re('rest', '[a-zA-Z]+')} >= 5 as substance from r""",
    "html_block_types": "select doc_id, [null, 'heading', 'paragraph', 'list', 'quote', 'code', 'table', 'paragraph', null][length(text) % 9 + 1] as type from documents",
    "html_style": f"""with d as (select doc_id, doc_id % 5 as a, lower({STYLE}) as s, lower({CLASS}) as c from documents)
select doc_id, a = 0 or (contains(s, 'font-weight') and (contains(s, 'bold') or contains(s, '700'))) or contains(c, 'bold') or contains(c, 'strong') as bold,
  a = 1 or (contains(s, 'font-style') and contains(s, 'italic')) or contains(c, 'italic') or contains(c, 'em') as italic,
  case when contains(s, 'text-align') then case when contains(s, 'center') then 'center' when contains(s, 'right') then 'right' when contains(s, 'left') then 'left' end end as alignment from d""",
    "epub_font_size": f"""with {headed(FONT_HEAD)}, s as (select doc_id, pos, line as t, case pos % 4 when 0 then (pos % 5 + 10) * 1.33::double when 1 then (pos % 5 + 10)::double when 2 then (pos % 5 + 10) * 16::double end as size from raw_lines),
m as (select *, max(size) over (partition by doc_id) as most from s where size is not null and t <> ''),
k as (select *, row_number() over (partition by doc_id, t order by pos) as rn from m where size >= most * 0.75 and length(t) between 6 and 99 and not contains('{_END}', t[-1]))
select doc_id, 3 as prio, 3 as confidence, 'font_size' as source, 'f' as file_path, 0 as position, pos::bigint as enc_pos, t as title, case when size = most then 1 else 2 end as level, 0 as tag_level from k where rn = 1""",
    "epub_pattern": f"""with {_BOOK_TEXTS}, h as (select doc_id, pattern, level, nth, position, {strip("m")} as title from hits)
select doc_id, pattern, nth::int as nth, position::int as position, title, level from h where {title_ok("title")}""",
    "epub_stopwords": f"with {headed(BOOK_HEAD)}, t as (select *, line as title from raw_lines) select doc_id, pos::int as pos, regexp_matches(lower(title), '{_STOP}') as stop, {title_ok('title')} as ok from t",
    "epub_validate": f"with {_CANDS} select doc_id, prio, pos::int as enc_pos, title from valid",
    "epub_choose": f"""with {_CANDS}, n as (select doc_id, prio, count(*) as n from valid group by 1, 2),
r as (select *, row_number() over (partition by doc_id order by n < 2, case when n >= 2 then prio else prio - 5 end, n desc, prio) as r from n)
select doc_id, prio, n, 'way' || prio || case when n < 2 then ' (备选)' else '' end as label from r where r = 1""",
    "epub_content_range": f"with {_RANGES} select doc_id, file_path, position, file_idx, until from rg",
    "epub_build": f"""with {_RANGES}, b as (select rg.doc_id, file_idx, position, any_value(title) as title, count(*) as n_files, sum(length(f.text))::bigint as word_count from rg join f on f.doc_id = rg.doc_id and idx >= file_idx and idx < until group by 1, 2, 3)
select doc_id, (row_number() over (partition by doc_id order by file_idx, position))::int as chapter_index, title, 1 as level, n_files, word_count from b where word_count > 0""",
    "epub_mojibake_ratio": "select doc_id, round(length(regexp_replace(text, '[^\\x{80}-\\x{24f}]', '', 'g')) / length(regexp_replace(text, '\\P{L}', '', 'g')), 9) as ratio from documents",
}

#: Extensions with the reader that takes them first, as one list.
_FORMATS = (
    "pdf pdf,epub epub,docx docx,doc docx,html html,htm html,xhtml html,md markdown,markdown markdown,mdown markdown,mkd markdown,mkdn markdown,json json,jsonl json,csv csv,tsv csv,tab csv,"
    "xml xml,xht xml,rss xml,atom xml,opml xml,rtf rtf,txt txt"
)
_CODE = "py pyw pyi pyc pyo js jsx ts tsx mjs cjs java class jar c cpp cc cxx h hpp hxx cs csx go rs rlib rb rbw php php3 php4 php5 phtml swift kt kts scala sc pl pm sh bash zsh fish ps1 psm1 sql css scss sass less yaml yml toml ini conf cfg properties env"
ORACLE_SQL["supported_formats"] = f"""select string_split(x, ' ')[1] as ext, string_split(x, ' ')[2] as reader from (select unnest(string_split('{_FORMATS}', ',')) as x)
union all select unnest(string_split('{_CODE}', ' ')), 'code'"""

_DOC_CHAPTERS = measured(_TOC_MATCH) + _PDF_CHAPTERS[len(_PDF) :]
ORACLE_SQL["pdf_document_chapters"] = f"""with {_DOC_CHAPTERS},
y1 as (select *, count(idx) over (partition by doc_id) as found from matched),
y2 as (select *, (row_number() over (partition by doc_id order by toc_pos))::int as chapter_index, lead(idx) over (partition by doc_id order by toc_pos) as stop from y1 where found >= 3 and idx is not null),
y3 as (select y2.doc_id, chapter_index, sum(length(replace(replace(text, ' ', ''), chr(10), '')))::bigint as wc, count(*) filter (where b.pos > idx and (body_sized or period or ratio < 1.15)) as pc
  from y2 join based b on b.doc_id = y2.doc_id and b.pos >= idx and (stop is null or b.pos < stop) group by 1, 2)
select doc_id, chapter_index, title, level, coalesce(wc, 0)::bigint as word_count, coalesce(pc, 0)::bigint as paragraph_count from y2 left join y3 using (doc_id, chapter_index)
union all select doc_id, (row_number() over (partition by doc_id order by seg))::int, title, level, word_count, paragraph_count from n4 where doc_id not in (select doc_id from y2)"""
