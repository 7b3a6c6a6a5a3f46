"""The same queries in SQL, written for themselves and not derived from the plans. DuckDB's regular expressions know no
look-around and have ASCII word borders; where that matters the text is prepared so that the result is the same."""

from __future__ import annotations

from leafmill.functions.rules import CHAPTER_LINE, HEADING_NUMBER, MATTER_BODY, MATTER_TITLE, PAGE_LINE, ROMAN, TERMINAL
from leafmill.functions.text import META, NOT_WS, WS
from leafmill.operators.glossary import STOPWORDS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(col: str) -> str:
    return f"coalesce(len(regexp_extract_all({col}, {q(NOT_WS + '+')})), 0)"


def strip(col: str) -> str:
    return f"regexp_replace({col}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def collapse(col: str) -> str:
    return f"trim(regexp_replace({col}, {q(WS + '+')}, ' ', 'g'), ' ')"


def despace(col: str) -> str:
    out = col
    for pattern in (r"(\p{Nd}) +(\p{Nd})", r"(\p{Nd}) +(,\p{Nd})", r"(\p{Nd},) +(\p{Nd})"):
        for _ in range(2):  # neighbours share a digit, so each rule runs twice
            out = f"regexp_replace({out}, {q(pattern)}, '\\1\\2', 'g')"
    return out


def resplit(col: str) -> str:
    """The word border before ``of`` is any character that is no letter, digit or underscore."""
    return f"regexp_replace({col}, {q('(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(of|off)([A-Z])')}, '\\1\\2 \\3', 'g')"


def upper(col: str) -> str:
    return f"(regexp_matches({col}, {q('[' + chr(92) + 'p{Lu}' + chr(92) + 'p{Lt}]')}) and not regexp_matches({col}, {q(chr(92) + 'p{Ll}')}))"


DIGITS = q(r"\p{Nd}")
DOCS = "docs as (select doc_id, text from documents where text is not null)"
LINES = f"""{DOCS},
page_rows as (select doc_id, unnest(string_split(text, chr(12))) as body, generate_subscripts(string_split(text, chr(12)), 1) - 1 as page from docs),
line_rows as (select doc_id, page, unnest(string_split(body, chr(10))) as raw, generate_subscripts(string_split(body, chr(10)), 1) as line from page_rows),
cut_rows as (select doc_id, page, line, regexp_replace(raw, {q(WS + '+$')}, '') as text from line_rows),
edges as (select doc_id, page, min(line) as lo, max(line) as hi from cut_rows where text <> '' group by all),
lines as (select c.doc_id, c.page, c.line - e.lo as line_no, c.text from cut_rows c join edges e using (doc_id, page) where c.line between e.lo and e.hi)"""
PAGE_TOKEN = rf"(regexp_matches(w, '^\p{{Nd}}+$') or (w <> '' and regexp_matches(w, {q(ROMAN)})))"
KEYS = f"""{LINES},
split_lines as (select doc_id, page, line_no, text, list_transform(regexp_extract_all(text, {q(NOT_WS + '+')}), lambda w: struct_pack(w := w, p := {PAGE_TOKEN})) as t from lines),
inner_tokens as (select doc_id, page, line_no, text, t, list_filter(range(1, len(t) + 1), lambda i: not t[i].p) as own from split_lines),
keyed as (select doc_id, page, line_no, text, lower(case when len(own) = 0 then '' else array_to_string(list_transform(t[own[1]:own[-1]], lambda x: x.w), ' ') end) as key from inner_tokens)"""
HEADS = f"""{KEYS},
page_counts as (select doc_id, count(distinct page) as pages from keyed group by doc_id),
heads as (select k.doc_id, k.key as head, count(*) as n from keyed k where {words('k.key')} >= 2 group by all),
running as (select h.doc_id, h.head, h.n from heads h join page_counts p using (doc_id) where h.n >= greatest(5, floor(0.12::double * p.pages)))"""
CONTENT = f"""{HEADS},
content as (select k.doc_id, k.page, k.line_no, {strip('k.text')} as text from keyed k left join running r on r.doc_id = k.doc_id and r.head = k.key where r.head is null and not regexp_matches({strip('k.text')}, {q(PAGE_LINE)})),
widths as (select doc_id, list_sort(list(len(text))) as w from content where text <> '' group by doc_id),
full_widths as (select doc_id, w[cast(floor(len(w) * 0.92::double) as bigint) + 1] as width from widths)"""
REFLOW = f"""{CONTENT},
ending as (
  select c.*, (text = '' or (len(text) < 0.80::double * width and (regexp_matches(text, {q(TERMINAL)}) or regexp_matches(text, {q(CHAPTER_LINE)}) or ({upper('text')} and {words('text')} <= 8)))) as stop
  from content c join full_widths using (doc_id)),
started as (select *, coalesce(lag(stop) over (partition by doc_id order by page, line_no), true) as first from ending),
islands as (select *, sum(case when first then 1 else 0 end) over (partition by doc_id order by page, line_no) as island from started),
written as (select *, row_number() over (partition by doc_id, island order by page, line_no) as k, lag(text) over (partition by doc_id, island order by page, line_no) as before, lead(text) over (partition by doc_id, island order by page, line_no) as after from islands where text <> ''),
glued as (select doc_id, island, string_agg(case when k = 1 or regexp_matches(before, '\\p{{L}}-$') then '' else ' ' end || case when after is not null and regexp_matches(text, '\\p{{L}}-$') then left(text, len(text) - 1) else text end, '' order by page, line_no) as raw from written group by all),
paragraphs_of as (select doc_id, row_number() over (partition by doc_id order by island) - 1 as ord, {strip(resplit(despace("regexp_replace(raw, '" + chr(92) + "x{ad} ?', '', 'g')")))} as text from glued)"""
HEADING = f"""(len(p) between 4 and 60 and {words('p')} <= 9 and not contains('—–-“”"''‘’', left(p, 1)) and right(p, 1) <> ':' and (regexp_matches(p, {q(HEADING_NUMBER)}) or
  ({upper('p')} and len(list_filter(regexp_extract_all(p, '[A-Za-z]+'), lambda w: len(w) >= 2)) >= 2 and not regexp_matches(array_to_string(list_filter(regexp_extract_all(p, '[A-Za-z]+'), lambda w: len(w) >= 2), ''), '^[IVXLCDM]+$'))))"""
CORE = f"regexp_replace(p, {q('^[' + chr(39) + chr(34) + '“”‘’]+|[' + chr(39) + chr(34) + '“”‘’]+$')}, '', 'g')"
TITLE = f"(len(p) <= 60 and {words('p')} <= 12 and len({CORE}) > 0 and not regexp_matches(left({CORE}, 1), '\\p{{Ll}}') and not contains('.!?…,;:', right({CORE}, 1)))"
PARS = "pars as (select id, any_value(book) as book, any_value(file) as file, any_value(idx) as idx, any_value(en) as en, any_value(lower(sha)) as sha from paragraphs group by id)"
NOW = "cur as (select * exclude (r) from (select *, row_number() over (partition by sha order by seq desc, landed_at desc) as r from translations) where r = 1)"
UNITS_NOW = "cur_units as (select * exclude (r) from (select *, row_number() over (partition by id order by (updated_at is not null) desc, updated_at desc, landed_at desc) as r from units) where r = 1)"
EN = f"{PARS}, {NOW}, ens as (select sha, min(en) as en from pars group by sha), pairs as (select c.*, coalesce(e.en, '') as en from cur c left join ens e using (sha))"
HAN, LAT = "len(regexp_extract_all(zh, '[\\x{4e00}-\\x{9fff}]'))", "len(regexp_extract_all(zh, '[A-Za-z]'))"
FLAGS = f"""{EN},
counted as (select *, {HAN} as han, {LAT} as latin, {words('en')} as words, list_sort(list_filter(list_distinct(regexp_extract_all(en, '\\p{{Nd}}+')), lambda n: len(n) >= 2 and not contains(zh, n))) as gone from pairs),
flagged as (select *, case when {strip('zh')} = '' then ['empty'] else list_filter([
  case when {strip('zh')} = {strip('en')} then 'identical' end,
  case when han > 0 and latin > 0.6::double * han then 'too_much_latin' end,
  case when words >= 12 and han / words < 0.8::double then 'too_short' when words >= 12 and han / words > 2.8::double then 'too_long' end,
  case when len(gone) > 0 then 'num_missing:' || array_to_string(gone[1:4], ',') end,
  case when regexp_matches(zh, {q(META)}) then 'meta_leak' end], lambda f: f is not null) end as flags from counted)"""
USABLE = f"(zh is not null and {strip('zh')} <> '' and not regexp_matches(zh, {q(META)}))"


def escape(col: str) -> str:
    out = col
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{raw}', '{safe}')"
    return out


HEAD_1, HEAD_2, TAIL = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="en">\n<head><meta charset="utf-8"/><title>', '</title>\n<link rel="stylesheet" type="text/css" href="styles.css"/></head>\n<body>\n', "\n</body>\n</html>\n"
SHOWN = f"{PARS}, {NOW}, shown as (select p.book, p.file, p.idx, p.en, coalesce(c.zh, '') as zh, coalesce({USABLE.replace('zh', 'c.zh')}, false) as ok from pars p left join cur c using (sha))"
PAGES = f"""{SHOWN},
bodies as (select book, file, string_agg('<p>' || {escape('en')} || '</p>' || case when ok then {q(chr(10) + '<p class="zh">')} || {escape('zh')} || '</p>' else '' end, chr(10) order by idx) as both_, string_agg('<p>' || {escape('case when ok then zh else en end')} || '</p>', chr(10) order by idx) as one_ from shown group by all),
numbered as (select *, row_number() over (partition by book order by file) as ord from bodies)"""
PACK = f"""recursive {PARS},
word_rows as (select book, file, idx, {words('en')} as w, row_number() over (partition by book, file order by idx) as k from pars where {words('en')} > 0),
packed as (
  select book, file, idx, k, 0 as unit, case when w >= 2500 then 1 else 0 end as next_unit, case when w >= 2500 then 0 else w end as total from word_rows where k = 1
  union all
  select r.book, r.file, r.idx, r.k, p.next_unit, case when p.total + r.w >= 2500 then p.next_unit + 1 else p.next_unit end, case when p.total + r.w >= 2500 then 0 else p.total + r.w end
  from packed p join word_rows r on r.book = p.book and r.file = p.file and r.k = p.k + 1),
file_counts as (select book, file, max(unit) + 1 as units, count(*) as n from packed group by all),
offsets as (select book, file, coalesce(sum(units) over w, 0) as u0, coalesce(sum(n) over w, 0) as p0 from file_counts window w as (partition by book order by file rows between unbounded preceding and 1 preceding))"""
CHAPTERS = f"""{REFLOW},
heads_of as (select doc_id, ord, text, (select {HEADING} from (select {strip('paragraphs_of.text')} as p)) as head from paragraphs_of)"""
CAP = f"[A-Z][a-zA-Z'.]+(?:{WS}+(?:of{WS}+|the{WS}+|de{WS}+)?[A-Z][a-zA-Z'.]+){{0,3}}"
WIDE_WS = WS.replace(r"\t-\r\x{1c}-\x{20}", "")[1:-1]
#: Letters and digits beyond ASCII become underscores: word characters that no phrase can hold, so ASCII borders do.
PHRASES = f"""{PARS},
marked as (select book, id, regexp_replace(en, {q('[^' + chr(92) + 'x00-' + chr(92) + 'x7f' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + WIDE_WS + ']')}, '~', 'g') as en from pars),
plain as (select book, id, regexp_replace(en, {q('[^' + chr(92) + 'x00-' + chr(92) + 'x7f' + WIDE_WS + ']')}, '_', 'g') as en from marked),
found as (select book, id, unnest(hits) as phrase, generate_subscripts(hits, 1) as pos from (select book, id, regexp_extract_all(en, {q(chr(92) + 'b' + CAP + chr(92) + 'b')}) as hits from plain)),
ranked as (select *, row_number() over (partition by book order by n desc, first, phrase) as r from (select book, phrase, count(*) as n, min((id, pos)) as first, min(id) as first_par from found where contains(phrase, ' ') or phrase not in ({', '.join(map(q, STOPWORDS))}) group by all)),
top as (select book, phrase, n, first_par from ranked where r <= 180 and n >= 3)"""

CONTEXTS = f"""{PHRASES},
hits as (select t.book, t.phrase, p.id, p.en, instr(p.en, t.phrase) - 1 as spot from top t join pars p on p.book = t.book and contains(p.en, t.phrase)),
first_hits as (select *, greatest(0, spot - 60) as lo, spot + len(phrase) + 60 as hi from (select *, row_number() over (partition by book, phrase order by id) as r from hits) where r = 1)"""
SHELF = f"""{PARS},
first_words as (select book, file, min_by(en, idx) as first from pars group by all),
docs_of as (select book, file, row_number() over (partition by book order by file) as ord, first from first_words),
spine_docs as (select book, file, ord, ord || '. ' || regexp_extract(first, '^[A-Za-z ]{{0,20}}') as heading from docs_of),
linked as (select book, file, ord from spine_docs where ord % 3 <> 0 and len(book) % 2 = 0),
link_counts as (select book, count(*) as n from linked group by 1),
chosen as (select book from link_counts where n >= 2),
listed as (
  select d.book, d.file, d.ord, case when c.book is not null and l.file is not null then 'To ' || d.file else d.heading end as title from spine_docs d left join chosen c using (book) left join linked l using (book, file)
  union all select book, 'contents.xhtml', 0, 'Contents' from link_counts where n < 2)"""

SQL: dict[str, str] = {
    "content_hash_dedup": f"with {DOCS} select sha1(text) as sha, count(*) as n, min(doc_id) as first_id from docs group by 1",
    "word_count": f"with {DOCS} select doc_id, cast({words('text')} as bigint) as words from docs",
    "shred_fraction": f"""with {DOCS}, t as (select doc_id, regexp_extract_all(text, {q(NOT_WS + '+')}) as t from docs)
select doc_id, case when len(t) = 0 then 0.0 else len(list_filter(t, lambda x: len(x) = 1 and regexp_matches(x, '\\p{{L}}') and x not in ('a', 'A', 'I', 'i'))) / len(t) end as fraction from t""",
    "despace_numbers": f"with {DOCS} select doc_id, md5({despace('regexp_replace(text, ' + q('(' + chr(92) + 'p{Nd})') + ', ' + q(chr(92) + '1 ') + ', ' + q('g') + ')')}) as digest from docs",
    "resplit_glue": f"with {DOCS} select doc_id, md5({resplit('replace(text, ' + q(' of ') + ', ' + q(' of') + ')')}) as digest from docs",
    "soft_hyphens": f"with {DOCS}, t as (select doc_id, regexp_replace(text, '\\x{{ad}} ?', '', 'g') as t from docs) select doc_id, len(t) as n, md5(t) as digest from t",
    "slugs": """with s as (select book, regexp_replace(regexp_replace(source_path, '^.*/', ''), '(.)\\.[^.]*$', '\\1') as a, regexp_replace(regexp_replace(title, '^.*/', ''), '(.)\\.[^.]*$', '\\1') as b from books),
n as (select book, left(lower(trim(regexp_replace(a, '[^A-Za-z0-9]+', '-', 'g'), '-')), 60) as a, left(lower(trim(regexp_replace(b, '[^A-Za-z0-9]+', '-', 'g'), '-')), 60) as b from s)
select book, case when a = '' then 'book' else a end as path_slug, case when b = '' then 'book' else b end as title_slug from n""",
    "html_escaped": f"with {DOCS} select doc_id, md5({escape('text')}) as digest from docs",
    "han_latin_counts": f"select distinct seq, {HAN} as han, {LAT} as latin from translations",
    "meta_flags": f"select distinct seq, regexp_matches(zh, {q(META)}) as meta, {USABLE} as usable from translations",
    "json_tolerant": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
    "lines": f"with {LINES} select doc_id, page::int as page, line_no::int as line_no, text from lines",
    "head_keys": f"with {KEYS} select key, count(*) as n from keyed group by 1",
    "line_kinds": f"with {LINES}, t as (select *, {strip('text')} as p from lines) select doc_id, page::int as page, line_no::int as line_no, regexp_matches(p, {q(PAGE_LINE)}) as page_number, {HEADING} as heading, {TITLE} as title from t",
    "running_heads": f"with {HEADS} select doc_id, head, n from running",
    "full_width": f"with {CONTENT} select doc_id, width from full_widths",
    "reflow_paragraphs": f"with {REFLOW} select doc_id, ord, md5(text) as digest from paragraphs_of",
    "matter_flags": f"""with {REFLOW},
m as (select doc_id, ord, text, {words('text')} as w, len(regexp_extract_all(text, {DIGITS})) as d from paragraphs_of),
s as (select doc_id, count(*) as n, sum(w) as w, count(*) filter (w <= 7) as short, count(*) filter (w >= 25 and d < 0.05::double * len(text)) as prose, count(*) filter (w <= 7 and d > 0) as num, min_by(text, ord) as first, string_agg(text, ' ' order by ord) filter (ord < 8) as opening from m group by doc_id)
select doc_id, (regexp_matches(first, {q(MATTER_TITLE)}) or (w < 300 and regexp_matches(opening, {q(MATTER_BODY)})) or (n >= 12 and short >= 0.6::double * n and prose < 3 and num >= 0.5::double * short)) as matter from s""",
    "chapter_split": f"""with recursive {CHAPTERS},
o as (select *, (head and not coalesce(lag(head) over (partition by doc_id order by ord), true)) as opens from heads_of),
g as (select *, sum(case when opens then 1 else 0 end) over (partition by doc_id order by ord) as island, bool_and(head) over (partition by doc_id) as lone from o),
b as (select *, bool_or(not head) over (partition by doc_id, island) as has_body from g),
h as (select doc_id, island, text, row_number() over (partition by doc_id, island order by ord) as k from b where head and has_body),
f as (select doc_id, island, k, text as title from h where k = 1 union all select h.doc_id, h.island, h.k, case when len(f.title) < 80 then f.title || ': ' || h.text else f.title end from f join h on h.doc_id = f.doc_id and h.island = f.island and h.k = f.k + 1),
t as (select doc_id, island, max_by(title, k) as title from f group by all),
r as (select b.doc_id, case when lone then 0 else b.island end as island, b.text, case when lone then '' else coalesce(t.title, '') end as title from b left join t on t.doc_id = b.doc_id and t.island = b.island where lone or (has_body and not head))
select doc_id, dense_rank() over (partition by doc_id order by island) as section, title, count(*) as paragraphs, sum(len(text))::bigint as chars from r group by doc_id, island, title""",
    "unit_packing": f"with {PACK} select p.book, p.file, p.idx::bigint as idx, p.unit::bigint as unit, (u0 + unit + 1)::bigint as unit_id, (p0 + k)::bigint as par_id from packed p join offsets using (book, file)",
    "latest_translations": f"with {NOW} select sha, seq, md5(zh) as zh, qa_state from cur",
    "latest_units": f"with {UNITS_NOW} select id, state, attempts from cur_units",
    "uncached_paragraphs": f"with {PARS} select id, sha from pars where sha not in (select sha from translations)",
    "prune_orphans": f"with {PARS}, {NOW} select sha, seq from cur where sha in (select sha from pars)",
    "interleave": f"with {PAGES} select book, file, ord, md5({q(HEAD_1)} || 'Part ' || ord || {q(HEAD_2)} || '<h2>Part ' || ord || '</h2>' || chr(10) || both_ || {q(TAIL)}) as digest from numbered",
    "zh_only_pages": f"with {PAGES} select book, file, 'Part ' || ord as title, len({q(HEAD_1)} || 'Part ' || ord || {q(HEAD_2)} || '<h2>Part ' || ord || '</h2>' || chr(10) || one_ || {q(TAIL)}) as chars from numbered",
    "l1_flags": f"with {FLAGS} select sha, array_to_string(list_transform(flags, lambda f: f), ';') as flags, case when words > 0 then cast(floor(han * 1000 / words) as bigint) end as ratio_millis from flagged",
    "l1_histogram": f"with {FLAGS}, f as (select unnest(case when len(flags) = 0 then ['ok'] else flags end) as flag from flagged) select regexp_replace(flag, ':.*$', '') as flag, count(*) as n from f group by 1",
    "qa_histogram": f"with {NOW} select book, qa_state, count(*) as n from cur group by all",
    "unit_status": f"""with {PARS}, {NOW}, {UNITS_NOW},
u as (select book, count(*) as units, count(*) filter (state = 'done') as done, count(*) filter (state = 'failed' and attempts >= 5) as stuck from cur_units group by 1),
p as (select book, count(*) as paragraphs from pars group by 1),
t as (select book, count(*) as translations, count(*) filter (qa_state = 'failed') as failed from cur group by 1)
select book, coalesce(units, 0) as units, coalesce(done, 0) as done, coalesce(stuck, 0) as stuck, coalesce(paragraphs, 0) as paragraphs, coalesce(translations, 0) as translations, coalesce(failed, 0) as failed from u full join p using (book) full join t using (book)""",
    "workable_units": f"with {UNITS_NOW} select id, state, attempts from cur_units where state in ('pending', 'failed') and attempts < 5",
    "qa_worklist": f"with {NOW} select sha, case qa_state when 'untested' then 'l1' else 'l2' end as step from cur where qa_state in ('untested', 'l1flag')",
    "qa_sample": f"with {NOW}, s as (select book, sha, row_number() over (partition by book order by sha1(sha || 'seed')) as r, count(*) over (partition by book) as n from cur where qa_state = 'l1ok') select book, sha from s where r <= floor(n * 0.2::double)",
    "qa_batches": f"with {NOW} select book, sha, ((row_number() over (partition by book order by sha) - 1) // 8)::bigint as batch from cur where qa_state = 'l1flag'",
    "verdict_rule": f"""with {NOW}, v as (select sha, cast(regexp_extract(qa_reason, 'faithful=([0-9]+)', 1) as int) as f, contains(qa_reason, 'missing=True') as m, contains(qa_reason, 'halluc=True') as h from cur where qa_reason like 'faithful=%')
select sha, (f <= 2 or ((m or h) and f <= 3)) as bad from v""",
    "glossary_top": f"with {PHRASES} select book, phrase, n, first_par from top",
    "glossary_context": f"with {CONTEXTS} select t.book, t.phrase, coalesce(case when lo > 0 then '…' else '' end || {collapse('substring(h.en, lo + 1, hi - lo)')} || case when hi < len(h.en) then '…' else '' end, '') as ctx from top t left join first_hits h using (book, phrase)",
    "contents_links": f"with {SHELF} select book, 'contents.xhtml' as page, count(*) as n, min('To ' || file) as first_title from linked group by 1",
    "pick_contents": f"with {SHELF} select book, 'contents.xhtml' as page from chosen",
    "merge_toc": f"with {SHELF} select book, file, ord, title from listed",
    "expand_toc": f"""with {SHELF},
entries as (select book, ord, 0 as pos, title, file as href from listed where ord % 4 <> 0 or ord = 0 union all select book, ord, k, 'CHAPTER ' || k || ' of ' || file, file || '#c' || k from spine_docs, (values (1), (2)) t(k) where ord % 4 = 0)
select book, row_number() over (partition by book order by ord, pos) as play_order, title, href from entries""",
    "dom_round_trip": f"""with {PARS}, c as (select book, file, idx, en, dense_rank() over (partition by book order by file) as chapter from pars),
k as (select book, chapter, row_number() over (partition by book, chapter order by idx) as pos, en from c where regexp_matches(en, '\\p{{L}}'))
select book, chapter, pos, md5(regexp_replace({strip('en')}, '[ \\t\\r\\n]+', ' ', 'g')) as digest from k""",
}

#: The lines on pages of five under a head, in place of the lines as they are.
HEADED = LINES.replace("\nlines as (", "\nplain_lines as (") + """,
counted_lines as (select doc_id, row_number() over (partition by doc_id order by page, line_no) - 1 as n, text from plain_lines),
lines as (select doc_id, n // 5 as page, n % 5 + 1 as line_no, text from counted_lines union all select doc_id, n // 5, 0, 'The  House by the Water ' || (n // 5 + 1) from counted_lines where n % 5 = 0)"""
LISTED = f"""{PARS},
first_words as (select book, file, min_by(en, idx) as first from pars group by all),
spine_docs as (select book, file, row_number() over (partition by book order by file) as ord, first from first_words),
headed as (select book, file, ord, ord || '. ' || regexp_extract(first, '^[A-Za-z ]{{0,20}}') as heading, ord % 7 = 0 as card from spine_docs),
seconds as (select book from (select book, row_number() over (order by book) as n from (select distinct book from headed)) where n % 2 = 0),
linked as (select h.book, h.file, h.ord, row_number() over (partition by h.book order by h.ord) - 1 as pos from headed h join seconds using (book) where ord % 3 <> 0),
chosen as (select book from linked group by 1 having count(*) >= 2),
entries as (
  select h.book, h.file, h.ord, 'To ' || h.file as title from headed h join chosen using (book) join linked l using (book, file)
  union all select h.book, h.file, h.ord, h.heading from headed h left join chosen c using (book) left join linked l using (book, file) where (c.book is null or l.file is null) and not h.card
  union all select book, 'contents.xhtml', 0, 'Contents' from seconds where book in (select book from linked) and book not in (select book from chosen)),
points as (
  select book, ord, 0 as pos, title, file as href from entries where ord % 4 <> 0 or ord = 0
  union all select book, ord, k, 'CHAPTER ' || k || ' of ' || file, file || '#c' || k from headed, (values (1), (2)) t(k) where ord % 4 = 0)"""
MADE = f"""{PARS}, files_of as (select book, file, row_number() over (partition by book order by file) as ord from (select distinct book, file from pars)),
first_pars as (select book, file, min_by(en, idx) as first from pars group by all)"""
OFFLINE = "regexp_replace({}, '[A-Za-z]+', '译文', 'g')"
COUNTS = FLAGS[FLAGS.index("counted as ("):]
FAILED = f"""{EN.replace("pairs as (", "all_pairs as (")}, pairs as (select sha, en, {strip(OFFLINE.format('en'))} as zh from all_pairs where qa_state = 'failed' and en <> ''),
{COUNTS}"""

SQL |= {
    "listed_contents_links": f"with {LISTED} select book, 'contents.xhtml' as page, pos::bigint as pos, file as target, 'To ' || file as title from linked",
    "listed_pick_contents": f"with {LISTED} select book, 'contents.xhtml' as page from chosen",
    "listed_merge_toc": f"with {LISTED} select book, file, ord, title from entries",
    "listed_expand_toc": f"with {LISTED} select book, row_number() over (partition by book order by ord, pos) as play_order, title, href from points",
    "package_rewrites": f"with {LISTED} select book, 'zh+en' as languages, row_number() over (partition by book order by ord, pos) as play_order, title, href from points",
    "page_headings": f"""with {MADE} select book, file, case ord % 5 when 0 then 'Old Works' when 1 then 'CHAPTER ' || ord when 2 then ord || '. The Inn' when 3 then 'Part IV: The Mill' else 'Book two' end as heading, ord % 5 = 0 as other_works from files_of""",
    "chapter_starts": f"""with {MADE} select book, file, case ord % 5 when 1 then 'CHAPTER ' || ord || ' — “THE LONG ROAD HOME”' when 2 then ord || '. The Inn' when 3 then 'Part IV: The Mill' else 'Book two' end as label, case when ord % 5 = 3 then 'x' else 'ebz-ch001' end as anchor from files_of where ord % 5 <> 0""",
    "injected_pages": f"""with {SHOWN}, n as (select book, file, row_number() over (partition by book, file order by idx) - 1 as pos, zh, ok from shown where regexp_matches(en, '\\p{{L}}'))
select book, file, pos, md5(regexp_replace(zh, '\\r\\n?', chr(10), 'g')) as digest from n where ok and zh <> ''""",
    "large_classes": """with b as (select book, row_number() over (order by book) as n from books)
select book, 'e' as class from b union all select book, unnest(['a' || n, 'b']) from b where n % 10 > 0 union all select book, 'd' || n from b where 9 + n % 12 > 16""",
    "offline_translation": f"with {PARS}, e as (select distinct sha, en from pars where sha not in (select sha from translations) and {words('en')} > 0) select sha1(en) as sha, md5({strip(OFFLINE.format('en'))}) as digest, cast(null as varchar) as error from e",
    "offline_verdicts": f"with {NOW} select sha, false as bad from cur where qa_state = 'l1flag'",
    "offline_repairs": f"with {FAILED} select sha, len(flags) = 0 as taken from flagged",
    "planted_heads": f"with {HEADS.replace(LINES, HEADED)} select doc_id, head, n from running",
    "reflow_without_heads": f"with {REFLOW.replace(LINES, HEADED)} select doc_id, ord, md5(text) as digest from paragraphs_of",
    "index_trim": f"""with {REFLOW},
e as (select doc_id, ord, row_number() over (partition by doc_id order by ord) - 1 as i, count(*) over (partition by doc_id) as n, case when len(regexp_extract_all(text, {DIGITS})) / greatest(1, len(text)) >= 0.10::double then 1 else 0 end as dense from paragraphs_of),
f as (select *, sum(dense) over (partition by doc_id order by ord rows between current row and 3 following) as ahead from e),
g as (select doc_id, min(case when n >= 20 and i >= floor(n * 0.75::double) and dense = 1 and ahead >= 3 then i end) as cut from f group by doc_id)
select f.doc_id, count(*) as kept from f join g using (doc_id) where cut is null or i < cut group by 1""",
    "flagship": f"""with {REFLOW}, texts as (select distinct sha1(text) as sha, text as en from paragraphs_of where {words('text')} > 0),
pairs as (select sha, en, {strip(OFFLINE.format('en'))} as zh from texts where sha not in (select sha from translations)),
{COUNTS}, f as (select unnest(case when len(flags) = 0 then ['ok'] else flags end) as flag from flagged) select regexp_replace(flag, ':.*$', '') as flag, count(*) as n from f group by 1""",
}
