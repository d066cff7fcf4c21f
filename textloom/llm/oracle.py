"""SQL of the pN_ queries that SQL can express; the others are tested by brute force, round trips and held-out accuracy."""

from __future__ import annotations

from textloom.llm import forms

_SECTIONS = "(select distinct section_id, doc_id, canonical_type, content from article_section)"

P2_FOUND = f"""with s as (select section_id, content, coalesce(l.max_chars, d.max_chars) as most from {_SECTIONS} s
left join section_limits l on l.canonical_type = s.canonical_type and l.canonical_type <> '*' left join section_limits d on d.canonical_type = '*')
select distinct section_id, cast(list_max(list_transform(regexp_split_to_array(content, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda w: length(w))) > most as int) as forced from s where length(content) > most"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SAME = forms.CYRILLIC | forms.GREEK | forms.LATIN
_ALL = _SAME | forms.NEAR
_INVISIBLE = r"[\x{00ad}\x{034f}\x{061c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]"
_BLANK = r"[\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x0b\x0c\x{0085}\x{2028}\x{2029}]"
_EMOJI_JOINT = r"([\x{2600}-\x{27bf}\x{1f000}-\x{1faff}\x{fe0f}])[\x{200d}\x{fe0f}]"
_WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}


def _translate(text: str, pairs: dict[str, str]) -> str:
    return f"translate({text}, {_sql(''.join(pairs))}, {_sql(''.join(pairs.values()))})"


def form(text: str) -> str:
    """The one form of a text: joints of emoji kept, other invisible characters dropped, blanks and wide forms made plain, composed; then each
    word in which a look-alike stands among Latin letters, or that consists of look-alikes, with Latin letters."""
    kept = rf"regexp_replace(regexp_replace(regexp_replace({text}, '{_EMOJI_JOINT}', '\1' || chr(57344), 'g'), '{_INVISIBLE}', '', 'g'), '{_BLANK}', ' ', 'g')"
    plain = f"nfc_normalize({_translate(kept, _WIDE)})"
    suspects, same, greek = "".join(_ALL), "".join(_SAME), "".join(forms.GREEK)
    stands = (
        f"case when not regexp_matches(w, '[{suspects}]') then w when regexp_matches(w, '^[{greek}{''.join(forms.NEAR)}]$') then w "
        f"when regexp_matches(regexp_replace(w, '[{suspects}]', '', 'g'), '\\p{{Latin}}') or regexp_matches(strip_accents(w), '^[{same}\\p{{N}}]+$') then {_translate('w', _ALL)} else w end"
    )
    return f"nfc_normalize(array_to_string(list_transform(regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}\\p{{M}}]+|[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda w: {stands}), ''))"


P6_FOUND = f"""select 'content' as field, section_id as record_key from (select distinct section_id, content as t from article_section where content <> '') where replace({form("t")}, chr(57344), '') <> regexp_replace(t, '{_EMOJI_JOINT}', '\\1', 'g')
union select 'doctor_answer', qa_identifier from (select distinct qa_identifier, doctor_answer as t from tamanh_qa where doctor_answer <> '') where replace({form("t")}, chr(57344), '') <> regexp_replace(t, '{_EMOJI_JOINT}', '\\1', 'g')"""

_SITES = r"""(select article_id as doc_id, max(site) as site from (select article_id, regexp_replace(case when length(given) > 0 then given else regexp_extract(lower(trim(source_url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) end, '^www\.', '') as site
from (select *, trim(regexp_replace(lower(coalesce(source_domain, '')), '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) as given from corpus_language_audit)) where article_id is not null and length(site) > 0 group by 1)"""
_LINES = f"""select section_id, doc_id, line_no, trim(regexp_replace(regexp_replace(lower(replace({form("raw")}, chr(57344), '')), '[\\s\\p{{Z}}\\x1c-\\x1f]+', ' ', 'g'), '\\p{{Nd}}+', '0', 'g')) as line
from (select section_id, doc_id, generate_subscripts(ls, 1) as line_no, unnest(ls) as raw from (select section_id, doc_id, string_split(content, chr(10)) as ls from {_SECTIONS} where content is not null))"""
_PLACES = f"""with lines as ({_LINES}), docs as (select d.doc_id, s.site from (select distinct doc_id from article_section where doc_id is not null) d join {_SITES} s using (doc_id)),
sizes as (select site, count(*) as m from docs group by 1), often as (select site, line from (select distinct doc_id, line from lines where line <> '') l join docs using (doc_id) join sizes using (site) group by site, line, m having count(*) >= 3 and count(*) >= 0.2 * m),
places as (select distinct section_id, line_no from lines join docs using (doc_id) join often using (site, line))"""
P3_FOUND = f"{_PLACES} select section_id, cast(line_no as int) as line_no from places"
P3_CLEAN = f"""{_PLACES}, gone as (select section_id, list(line_no) as gone from places group by 1)
select distinct s.section_id, case when g.gone is null then content else array_to_string(list_filter(string_split(content, chr(10)), lambda x, i: not list_contains(g.gone, i)), chr(10)) end as content from {_SECTIONS} s left join gone g using (section_id)"""

_SHINGLES = f"""with t as (select 'abstract' as field, doc_id as id, abstract as text from article_extraction union select 'doctor_answer', qa_id, doctor_answer from tamanh_qa),
w as (select field, id, regexp_extract_all(lower(replace({form("text")}, chr(57344), '')), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') as ws from t where text is not null and id is not null),
s as (select distinct field, id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as g from w where len(ws) >= 60),
n as (select field, id, count(*) as n from s group by 1, 2),
p as (select a.field, a.id as a_id, b.id as b_id, count(*) as k from s a join s b on a.field = b.field and a.g = b.g and a.id < b.id group by 1, 2, 3),
pairs as (select p.field, a_id, b_id, k, x.n as na, y.n as nb from p join n x on x.field = p.field and x.id = a_id join n y on y.field = p.field and y.id = b_id where k >= 0.5 * (x.n + y.n - k))"""
P5_FOUND = f"{_SHINGLES} select field, a_id, b_id from pairs"

P5_CLASSES = f"""{_SHINGLES.replace("with t as", "with recursive t as", 1)}, texts as (select field, id, md5(string_agg(g, '|' order by g)) as k from s where (field, id) in (select (field, id) from n) group by 1, 2),
sides as (select field, a_id as a, b_id as b from pairs union select field, b_id, a_id from pairs),
reach(field, id, r) as (select field, id, id from texts union select reach.field, reach.id, sides.b from reach join sides on sides.field = reach.field and sides.a = reach.r),
links as (select x.field, x.id, count(distinct y.k) as links from sides join texts x on x.field = sides.field and x.id = sides.a join texts y on y.field = sides.field and y.id = sides.b where x.k <> y.k group by 1, 2)
select field, id, min(r) as class_id, coalesce(max(links.links), 0) as links from reach left join links using (field, id) group by 1, 2"""

ORACLE = {"p5_classes": P5_CLASSES, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_clean": P3_CLEAN, "p5_found": P5_FOUND, "p6_found": P6_FOUND}
