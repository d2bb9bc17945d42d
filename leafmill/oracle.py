"""SQL for DuckDB that gives the same rows as the queries of the core, where SQL can express them."""

from __future__ import annotations

from .functions.text import BULLET, HAN, HANGUL, HEBREW, KANA, LIGATURES, RIGHT_TO_LEFT, SPACE
from .operators.stats import DEFAULT_CREATED, DEFAULT_CREATOR, DEFAULT_REVISION


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+', '')"


B = "b as (select distinct doc_id, page_no, block_idx, text, x_left, y_bottom, x_right, y_top, font_size, block_role, color, vertical, background_color, opacity from text_blocks)"
P = "p as (select distinct doc_id, page_no, width, height from pdf_pages)"
READ = "y_top desc nulls last, x_left nulls last, block_idx"
SHOWN = f"coalesce({_strip('text')} <> '', false)"
MARGINS = f"""box as (select doc_id, page_no, min(x_left) l, max(x_right) r, max(y_top) t, min(y_bottom) bt from b where {SHOWN} group by all),
m as (select p.doc_id, p.page_no, width, height,
  case when l is null then 72.0 else greatest(12.0, least(l, width / 2)) end margin_left, case when r is null then 72.0 else greatest(12.0, least(width - r, width / 2)) end margin_right,
  case when t is null then 72.0 else greatest(12.0, least(height - t, height / 2)) end margin_top, case when bt is null then 72.0 else greatest(12.0, least(bt, height / 2)) end margin_bottom
  from p left join box using (doc_id, page_no))"""
COLUMNS = f"""g as (select doc_id, page_no, x_left - lag(x_left) over (partition by doc_id, page_no order by x_left, block_idx) gap from b where {SHOWN} and x_left is not null),
g2 as (select *, avg(gap) over (partition by doc_id, page_no) mean from g),
g3 as (select doc_id, page_no, count(*) n, coalesce(sum(case when gap > 2 * mean then 1 else 0 end), 0) wide, min(case when gap > 2 * mean then gap end) least_gap from g2 group by all),
c as (select doc_id, page_no, (case when n < 4 or wide = 0 then 1 else least(wide + 1, 3) end)::int columns, case when not (n < 4 or wide = 0) then least_gap end spacing from g3)"""
PLACED = f"""pl as (select b.*, m.* exclude (doc_id, page_no), coalesce(c.columns, 1) columns, c.spacing, row_number() over (partition by b.doc_id order by b.page_no, {READ}) seq
  from b join m using (doc_id, page_no) left join c using (doc_id, page_no))"""
COLUMN_NO = """(case when columns <= 1 or (width - margin_left - margin_right - coalesce(spacing, 18.0) * (columns - 1)) / columns <= 0 then 0 else
  least(greatest(ceil((greatest(x_left - margin_left, 0.0) - 0.1 - (width - margin_left - margin_right - coalesce(spacing, 18.0) * (columns - 1)) / columns)
  / ((width - margin_left - margin_right - coalesce(spacing, 18.0) * (columns - 1)) / columns + coalesce(spacing, 18.0))), 0), columns - 1) end)::int"""
PATTERNS = {"bullet": f"^({BULLET})[{SPACE}]+", "decimal": rf"^(\(?\d+[.)])[{SPACE}]+", "roman": rf"^(\(?[ivxlcdmIVXLCDM]+[.)])[{SPACE}]+", "alpha": rf"^(\(?[a-zA-Z]+[.)])[{SPACE}]+"}
MARKED = f"""w as (select *, {_lstrip('text')} wk from b where text is not null),
k as (select *, case {' '.join(f"when regexp_matches(wk, '{p}') then '{k}'" for k, p in PATTERNS.items())} when upper(block_role) in ('LI', 'LBODY', 'LBL', 'L') then 'role' end how from w),
mk as (select *, case how {' '.join(f"when '{k}' then regexp_extract(wk, '{p}', 1)" for k, p in PATTERNS.items())} end marker,
  case how {' '.join(f"when '{k}' then left(text, length(text) - length(wk)) || regexp_replace(wk, '{p}', '')" for k, p in PATTERNS.items())} else text end rest0 from k where how is not null),
marks as (select doc_id, page_no, block_idx, case when how in ('bullet', 'role') then 'bullet' else 'ordered' end kind,
  case how when 'decimal' then 'decimal' when 'roman' then case when regexp_replace(marker, '[().]', '', 'g') = upper(regexp_replace(marker, '[().]', '', 'g')) then 'upperRoman' else 'lowerRoman' end
    when 'alpha' then case when regexp_replace(marker, '[().]', '', 'g') = upper(regexp_replace(marker, '[().]', '', 'g')) then 'upperLetter' else 'lowerLetter' end end format,
  case when how in ('bullet', 'role') then null when marker like '(%)' then 'enclosed' when marker like '%)' then 'paren' else 'dot' end punctuation, marker, case when rest0 = '' then text else rest0 end rest from mk)"""
AREA = "greatest(greatest(b.x_right - b.x_left, 0) * greatest(b.y_top - b.y_bottom, 0), 1.0)"
SCORE = f"(greatest(least(b.x_right, o.rx) - greatest(b.x_left, o.lx), 0) * greatest(least(b.y_top, o.ty) - greatest(b.y_bottom, o.bx), 0)) / {AREA}"
HEADER = f"lower(regexp_replace({_strip('text')}, '[{SPACE}]+', ' ', 'g'))"
FOOTER0 = _strip(f"regexp_replace(regexp_replace({HEADER}, '[0-9]+', '', 'g'), '[{SPACE}]+', ' ', 'g')")
FOOTER = f"case when {FOOTER0} = '' then {HEADER} else {FOOTER0} end"
MARK = f"lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}*†‡]', '', 'g'))"
STATS = f"""count(*) paragraphs, sum(case when s <> '' then len(regexp_extract_all(s, '[^{SPACE}]+')) else 0 end)::bigint words, sum(case when s <> '' then length(s) - length(replace(s, chr(10), '')) + 1 else 0 end)::bigint "lines",
  sum(case when s <> '' then length(s) else 0 end)::bigint characters, sum(length(t))::bigint characters_with_spaces"""
N = "(select doc_id, page_no + 1 page from p)"


SAME = """(abs(h.width - p.width) <= 0.5 and abs(h.height - p.height) <= 0.5 and abs(h.margin_left - p.margin_left) <= 6 and abs(h.margin_right - p.margin_right) <= 6 and abs(h.margin_top - p.margin_top) <= 6
  and abs(h.margin_bottom - p.margin_bottom) <= 6 and (h.spacing is null and p.spacing is null or coalesce(abs(h.spacing - p.spacing) <= 3, false)) and h.columns = p.columns and (h.width > h.height) = (p.width > p.height))"""
SECTIONS = f"""pg as (select m.*, coalesce(c.columns, 1) columns, c.spacing, row_number() over (partition by m.doc_id order by m.page_no) rn from m left join c using (doc_id, page_no) where width is not null and height is not null),
sec as (select doc_id, page_no, rn, 0 section_no, page_no first_page from pg where rn = 1 union all
  select p.doc_id, p.page_no, p.rn, case when {SAME} then s.section_no else s.section_no + 1 end, case when {SAME} then s.first_page else p.page_no end
  from sec s join pg h on h.doc_id = s.doc_id and h.page_no = s.first_page join pg p on p.doc_id = s.doc_id and p.rn = s.rn + 1),
sp as (select sec.doc_id, sec.page_no, section_no, first_page, h.* exclude (doc_id, page_no, rn) from sec join pg h on h.doc_id = sec.doc_id and h.page_no = sec.first_page)"""
# paragraphs: each block with text against the one before, and the role of its paragraph's first block
END = f"right(regexp_replace(text, '[{SPACE}]+$', ''), 1)"
WALK = f"""q0 as (select b.*, sp.* exclude (doc_id, page_no), {END} not in ('', '.', '!', '?') and not coalesce(starts_with(upper(block_role), 'H'), false) cont, row_number() over (partition by b.doc_id order by b.page_no, {READ}) r
  from b join sp using (doc_id, page_no) where {SHOWN} and x_left is not null and y_bottom is not null and x_right is not null and y_top is not null),
q as (select q0.*, {COLUMN_NO} col, marks.kind is not null listed from q0 left join marks using (doc_id, page_no, block_idx)),
st as (select n.*, l.doc_id is not null and not n.listed and not coalesce(n.vertical, false) and not coalesce(l.vertical, false) and l.section_no = n.section_no and (n.columns <= 1 or l.col = n.col)
  and case when l.page_no = n.page_no then l.y_bottom - n.y_top <= 1.2 * coalesce(nullif(n.font_size, 0), nullif(l.font_size, 0), 12.0)
  else l.cont and l.y_top >= n.margin_bottom + greatest(2 * coalesce(nullif(n.font_size, 0), nullif(l.font_size, 0), 12.0), 24.0) and l.y_top <= n.height - n.margin_top - greatest(2 * coalesce(nullif(n.font_size, 0), nullif(l.font_size, 0), 12.0), 24.0)
    and n.y_top >= n.height - n.margin_top - greatest(2 * coalesce(nullif(n.font_size, 0), nullif(l.font_size, 0), 12.0), 24.0) end joins
  from q n left join q l on l.doc_id = n.doc_id and l.r = n.r - 1),
walk as (select doc_id, page_no, block_idx, r, block_role lead_role, true new_paragraph, 1 paragraph_no from st where r = 1 union all
  select n.doc_id, n.page_no, n.block_idx, n.r, case when n.joins and not coalesce(nullif(n.block_role, '') <> nullif(w.lead_role, ''), false) then w.lead_role else n.block_role end,
    not (n.joins and not coalesce(nullif(n.block_role, '') <> nullif(w.lead_role, ''), false)), w.paragraph_no + case when n.joins and not coalesce(nullif(n.block_role, '') <> nullif(w.lead_role, ''), false) then 0 else 1 end
  from walk w join st n on n.doc_id = w.doc_id and n.r = w.r + 1)"""


def _regions(footer: bool) -> str:
    near = "y_bottom <= margin_bottom + 24" if footer else "height - y_top <= margin_top + 24"
    order = "y_bottom, x_left, block_idx" if footer else "y_top desc, x_left, block_idx"
    read = B
    if footer:  # the pages are numbered at their foot
        read = B.replace("b as (", "b0 as (", 1) + ", b as (select doc_id, page_no, block_idx, text, x_left, y_bottom, x_right, y_top from b0 union all select distinct doc_id, page_no, -1, 'Page ' || (page_no + 1), 280.0, 20.0, 330.0, 32.0 from pdf_pages)"
    return f"""with recursive {read}, {P}, {MARGINS}, {COLUMNS}, {SECTIONS}, a as (select b.doc_id, b.page_no, section_no, row_number() over (partition by b.doc_id, b.page_no order by {order}) rk, {FOOTER if footer else HEADER} sig
      from b join sp using (doc_id, page_no) where {SHOWN} and {near}),
    f as (select doc_id, section_no, page_no, string_agg(sig, chr(10) order by rk) signature from a where rk <= 3 group by all),
    n as (select doc_id, section_no, signature, count(*) pages, min(page_no) first_page from f group by all having count(*) >= 2),
    r as (select *, row_number() over (partition by doc_id, section_no order by pages desc, first_page, signature) rn from n)
    select r.doc_id, r.section_no, r.signature, r.pages, r.first_page, case when o.signature <> r.signature then o.page_no end first_variant from r
    left join (select f.* from f join sp using (doc_id, page_no) where f.page_no = sp.first_page) o using (doc_id, section_no) where rn = 1"""


def _ligatures(x: str) -> str:
    for a, b in LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    return _strip(x)


def oracle_sql() -> dict[str, str]:
    dup = "select distinct * exclude (ingested_at)"
    out = {
        "text_normalised": f"select doc_id, {_ligatures("replace(text, chr(173), '')")} clean from documents",
        "text_language": f"""with {B} select doc_id, page_no, block_idx, case when text is null or text = '' then null when regexp_matches(text, '[{RIGHT_TO_LEFT}]') then case when regexp_matches(text, '[{HEBREW}]') then 'he-IL' else 'ar-SA' end
            when regexp_matches(text, '[{HANGUL}]') then 'ko-KR' when regexp_matches(text, '[{KANA}]') then 'ja-JP' when regexp_matches(text, '[{HAN}]') then 'zh-CN' when regexp_matches(text, '[Ё-\U0010ffff]') then 'und' else 'en-US' end guess,
            regexp_matches(text, '[{RIGHT_TO_LEFT}]') rtl, regexp_matches(text, '[{HAN}{KANA}{HANGUL}]') east_asian from b""",
        "list_markers": f"with {B}, {MARKED} select * from marks",
        "style_numbers": f"""with {B}, {MARKED} select kind, format, punctuation, (case when kind = 'bullet' then 1 else 1 + (list_position(['decimal', 'lowerLetter', 'upperLetter', 'lowerRoman', 'upperRoman'], format) - 1) * 3
            + list_position(['dot', 'paren', 'enclosed'], punctuation) end)::int number_id, count(*) n from marks group by all""",
        "signature_text": f"with {B} select doc_id, page_no, block_idx, {HEADER} header, {FOOTER} footer from b",
        "font_traits": "select distinct font_name, contains(u, 'BOLD') or contains(u, 'BLACK') or contains(u, 'HEAVY') bold, contains(u, 'ITALIC') or contains(u, 'OBLIQUE') italic, contains(u, 'UNDERLINE') or contains(u, 'UL') underline from (select font_name, upper(coalesce(font_name, '')) u from fragments)",
        "pdf_dates": f"""with d as (select distinct doc_id, created, regexp_replace({_strip('created')}, '^D:', '') r from doc_metadata),
            e as (select doc_id, case when regexp_matches(r, '^[0-9]{{4}}') then try_strptime(left(r, 4) || case when length(r) >= 6 then substr(r, 5, 2) else '01' end || case when length(r) >= 8 then substr(r, 7, 2) else '01' end
              || case when length(r) >= 10 then substr(r, 9, 2) else '00' end || case when length(r) >= 12 then substr(r, 11, 2) else '00' end || case when length(r) >= 14 then substr(r, 13, 2) else '00' end, '%Y%m%d%H%M%S') end l,
              regexp_extract(r, '^[0-9]{{14}}([+-])([0-9]{{2}})''?([0-9]{{2}})', 1) sg, try_cast(regexp_extract(r, '^[0-9]{{14}}[+-]([0-9]{{2}})', 1) as int) * 60 + try_cast(regexp_extract(r, '^[0-9]{{14}}[+-][0-9]{{2}}''?([0-9]{{2}})', 1) as int) mi from d),
            f as (select doc_id, epoch_us(l) - (case when sg = '' then 0 when sg = '-' then -mi else mi end)::bigint * 60000000 utc_us from e)
            select doc_id, utc_us, strftime(make_timestamp(utc_us), '%Y-%m-%dT%H:%M:%SZ') w3c from f""",
        "footnote_markers": f"with {B} select doc_id, page_no, block_idx, {MARK} marker from b where regexp_matches({MARK}, '^([0-9]+|[*†‡]|\\p{{L}})$')",
        "anchor_names": f"""select distinct title, left(case when regexp_matches(a, '^[0-9]') then 'dest_' || a else a end, 40) anchor from (select title, regexp_replace({_strip('title')}, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') a from doc_metadata)""",
        "text_statistics": f"select doc_id, {STATS} from (select doc_id, coalesce(text, '') t, {_strip("coalesce(text, '')")} s from documents) group by doc_id",
        "document_statistics": f"""with {P}, q as ({dup} from paragraphs), t as (select doc_id, coalesce(array_to_string(list_transform(runs, lambda r: coalesce(r.text, '')), ''), '') t from q),
            s as (select doc_id, t, {_strip('t')} s from t), n as (select doc_id, count(*) pages from p group by 1)
            select s.doc_id, {STATS}, coalesce(any_value(n.pages), 0) pages from s left join n using (doc_id) group by s.doc_id""",
        "core_properties": f"""with d as ({dup} from doc_metadata) select doc_id, coalesce(nullif(title, ''), case when tagged then 'Tagged PDF' else 'PDF Conversion' end) title, coalesce(nullif(author, ''), '{DEFAULT_CREATOR}') creator, nullif(subject, '') subject,
            array_to_string(list_filter(list_transform(keywords, lambda x: {_strip('x')}), lambda x: x <> ''), ', ') keywords, coalesce(nullif(last_modified_by, ''), nullif(author, ''), '{DEFAULT_CREATOR}') last_modified_by,
            coalesce(nullif(created, ''), '{DEFAULT_CREATED}') created, coalesce(nullif(modified, ''), nullif(created, ''), '{DEFAULT_CREATED}') modified, nullif(language, '') "language", coalesce(nullif(revision, ''), '{DEFAULT_REVISION}') revision from d""",
        "metadata_overlay": f"""with d as ({dup} from doc_metadata), o as (select doc_id, max(last_modified_by) l, bool_or(tagged_pdf) t from conversions group by 1)
            select doc_id, title, author, coalesce(l, last_modified_by) last_modified_by, coalesce(t, tagged) tagged from d left join o using (doc_id)""",
        "page_margins": f"with {B}, {P}, {MARGINS} select * from m",
        "page_columns": f"with {B}, {COLUMNS} select doc_id, page_no, columns, spacing from c",
        "block_formats": f"""with {B}, {P}, {MARGINS}, {COLUMNS}, {PLACED} select doc_id, page_no, block_idx, {COLUMN_NO} column_no,
            case when width - margin_left - margin_right <= 0 then null when abs((x_left + x_right) / 2 - (margin_left + (width - margin_left - margin_right) / 2)) <= greatest(10.0, greatest(x_right - x_left, 1.0) * 0.1) then 'center'
            when x_right >= width - margin_right - 5.0 and x_left > margin_left + greatest(x_right - x_left, 1.0) * 0.25 then 'right' when greatest(x_right - x_left, 1.0) >= (width - margin_left - margin_right) * 0.9 then 'both' else 'left' end alignment,
            greatest(x_left - margin_left, 0.0) indent, case when font_size > 0 then round_even(least(greatest(greatest(y_top - y_bottom, 0) / font_size, 1.0), 2.5), 2) else 1.2 end line_spacing from pl""",
        "sections": f"with recursive {B}, {P}, {MARGINS}, {COLUMNS}, {SECTIONS} select doc_id, page_no, section_no, first_page from sec",
        "continuations": f"with recursive {B}, {P}, {MARGINS}, {COLUMNS}, {SECTIONS}, {MARKED}, {WALK} select doc_id, page_no, block_idx, new_paragraph, paragraph_no from walk",
        "heading_styles": f"""with recursive {B}, {P}, {MARGINS}, {COLUMNS}, {SECTIONS}, {MARKED}, {WALK}, h as (select b.*, coalesce(avg(font_size) over (partition by doc_id order by page_no, {READ} rows between unbounded preceding and 1 preceding), font_size) mean
              from b join (select doc_id, page_no, block_idx from walk where new_paragraph) using (doc_id, page_no, block_idx) where {SHOWN})
            select h.doc_id, h.page_no, h.block_idx, case when marks.kind is not null then 'ListParagraph' when regexp_matches(upper(block_role), '^H[0-9]+$') then 'Heading' || substr(block_role, 2) when upper(block_role) = 'TITLE' then 'Title'
            when upper(block_role) = 'SUBTITLE' then 'Subtitle' when upper(block_role) in ('QUOTE', 'BLOCKQUOTE') then 'Quote' when upper(block_role) in ('CODE', 'PRE') then 'Code' when upper(block_role) = 'CAPTION' then 'Caption'
            when font_size / mean >= 1.8 then 'Heading1' when font_size / mean >= 1.5 then 'Heading2' when font_size / mean >= 1.3 then 'Heading3' end style from h left join marks using (doc_id, page_no, block_idx)""",
        "block_spacing": f"""with {B}, s as (select *, coalesce(font_size, lag(font_size) over w, 12.0) sz, lag(y_bottom) over w - y_top bf, y_bottom - lead(y_top) over w af, lead(block_idx) over w is null last
            from b window w as (partition by doc_id, page_no order by {READ}))
            select doc_id, page_no, block_idx, case when bf > 0.5 * sz then bf end space_before, case when last then 0.6 * coalesce(font_size, 12.0) when af > 0.5 * coalesce(font_size, 12.0) then af end space_after from s""",
        "page_and_column_breaks": f"""with {B}, {P}, {MARGINS}, {COLUMNS}, {PLACED}, x as (select *, {COLUMN_NO} col from pl where {SHOWN}),
            y as (select *, row_number() over (partition by doc_id, page_no order by seq) = 1 first, min(page_no) over (partition by doc_id) start, row_number() over (partition by doc_id, page_no, col order by seq) = 1 fc from x)
            select doc_id, page_no, block_idx, first and page_no > start page_break, fc and not first column_break from y""",
        "edge_clusters": f"""with {B}, d as (select doc_id, page_no, x_left, count(*) here from b where x_left is not null group by all),
            e as (select *, case when x_left - lag(x_left) over (partition by doc_id, page_no order by x_left) <= 1.0 then 0 else 1 end nw from d),
            f as (select *, sum(nw) over (partition by doc_id, page_no order by x_left rows between unbounded preceding and current row) cn from e)
            select doc_id, page_no, cn::int cluster_no, sum(x_left * here) / sum(here) centre, sum(here)::bigint n from f group by doc_id, page_no, cn""",
        "roles_to_blocks": f"""with {B}, r as (select doc_id, page_no, block_role "role", row_number() over (partition by doc_id, page_no order by block_idx) k from b where block_role is not null),
            n as (select *, row_number() over (partition by doc_id, page_no order by {READ}) k from b) select doc_id, page_no, block_idx, "role" from n left join r using (doc_id, page_no, k)""",
        "link_matches": f"""with {B}, o as (select doc_id, page_no, block_idx link_idx, x_left + 4 lx, y_bottom - 3 bx, x_right + 4 rx, y_top - 3 ty from b where color is not null),
            s as (select b.doc_id, b.page_no, b.block_idx, link_idx, {SCORE} score from b join o using (doc_id, page_no)), r as (select *, row_number() over (partition by doc_id, page_no, block_idx order by score desc, link_idx) rn from s where score > 0.05)
            select doc_id, page_no, block_idx, link_idx, score from r where rn = 1""",
        "comment_matches": f"""with {B}, o as (select doc_id, page_no, block_idx annot_idx, x_left + 2 lx, y_bottom + 6 bx, x_right + 2 rx, y_top + 6 ty from b where color is null and trim(coalesce(text, '')) <> ''),
            s as (select b.doc_id, b.page_no, b.block_idx para_idx, annot_idx, {SCORE} score from b join o using (doc_id, page_no) where block_role is not null),
            r as (select *, row_number() over (partition by doc_id, page_no, annot_idx order by score desc, para_idx) rk from s where score > 0.1)
            select doc_id, page_no, annot_idx, para_idx, row_number() over (partition by doc_id order by page_no, annot_idx) - 1 comment_id from r where rk = 1""",
        "background_matches": f"""with {B}, o as (select doc_id, page_no, block_idx path_idx, x_left - 10 lx, y_bottom - 30 bx, x_right + 300 rx, y_top + 30 ty, background_color fill, coalesce(opacity, 1.0) alpha from b where background_color is not null),
            s as (select b.doc_id, b.page_no, b.block_idx, path_idx, fill, alpha, row_number() over (partition by b.doc_id, b.page_no, b.block_idx order by path_idx) rn from b join o using (doc_id, page_no)
              where b.text <> '' and alpha > 0.1 and b.x_left >= lx - 4 and b.y_bottom >= bx - 4 and b.x_right <= rx + 4 and b.y_top <= ty + 4)
            select doc_id, page_no, block_idx, path_idx, fill background, case when alpha < 1 then alpha end path_opacity from s where rn = 1""",
        "footnote_matches": f"""with {B}, ms as (select doc_id, page_no, block_idx seq, {MARK} marker from b where regexp_matches({MARK}, '^([0-9]+|[*†‡]|\\p{{L}})$')),
            bs as (select doc_id, page_no, block_idx seq, regexp_extract(text, '^([0-9]+|[*†‡]) ', 1) marker from b where regexp_matches(text, '^([0-9]+|[*†‡]) ')),
            m1 as (select *, row_number() over (partition by doc_id, marker, page_no order by seq) k from ms), b1 as (select *, row_number() over (partition by doc_id, marker, page_no order by seq) k from bs),
            n as (select doc_id, marker, page_no, count(*) n from ms group by all), c as (select doc_id, marker, page_no, count(*) c from bs group by all),
            w as (select b1.*, coalesce(n0.n, 0) n0, coalesce(least(np.n, coalesce(cp.c, 0)), 0) used from b1 left join n n0 using (doc_id, marker, page_no)
              left join n np on np.doc_id = b1.doc_id and np.marker = b1.marker and np.page_no = b1.page_no - 1 left join c cp on cp.doc_id = b1.doc_id and cp.marker = b1.marker and cp.page_no = b1.page_no - 1),
            v as (select doc_id, marker, page_no body_page, seq, case when k <= n0 then page_no else page_no - 1 end mp, case when k <= n0 then k else k - n0 + used end mk from w)
            select v.doc_id, v.marker, body_page, v.seq, mp marker_page, m1.seq marker_seq, row_number() over (partition by v.doc_id order by body_page, v.seq) + 1 footnote_id
            from v join m1 on m1.doc_id = v.doc_id and m1.marker = v.marker and m1.page_no = v.mp and m1.k = v.mk""",
        "header_regions": _regions(False),
        "footer_regions": _regions(True),
        "watermarks": f"""with {B}, {P}, ti as (select doc_id, max(title) title from doc_metadata where title <> '' group by 1),
            al as (select doc_id, page_no, text, x_left, y_bottom, x_right, y_top, opacity from b union all select doc_id, page_no, title, width / 2 - 90, height / 2 - 20, width / 2 + 90, height / 2 + 20, 0.4 from p join ti using (doc_id) where page_no % 5 <> 4),
            s as (select al.doc_id, al.page_no, {_strip('text')} text, (x_left + x_right) / 2 / width x, (y_bottom + y_top) / 2 / height y from al join p using (doc_id, page_no)
              where {SHOWN} and (opacity is null or opacity <= 0.8)), z as (select doc_id, count(*) n from p group by 1 having count(*) > 1),
            f as (select doc_id, text, round_even(x * 100, 0)::int x_percent, round_even(y * 100, 0)::int y_percent, count(distinct page_no) pages from s where x between 0.2 and 0.8 and y between 0.2 and 0.8 group by all)
            select f.* from f join z using (doc_id) where pages >= greatest(2, floor(n * 0.8))""",
        "pdf_fragments": f"""with {P}, f as (select distinct * exclude (ingested_at) from fragments) select doc_id, page_no - least_page page_no, text, round(x, 3) x, round(y, 3) y, font_name, round(coalesce(nullif(font_size, 0), 12.0), 3) font_size, coalesce(vertical, false) vertical
            from f join p using (doc_id, page_no) join (select doc_id, min(page_no) least_page from p group by 1) using (doc_id) where text <> '' and x is not null and y is not null""",
        "pdf_page_sizes": f"with {P} select doc_id, (row_number() over (partition by doc_id order by page_no) - 1)::int page_no, round(width, 3) width, round(height, 3) height from p",
        "pdf_split_files": f"""with {P}, n as (select doc_id, count(*) n from p group by 1), a as (select doc_id, n, unnest(generate_series(1, n, 2)) a from n)
            select replace(doc_id, ' ', '_') || '_' || case when a = least(n, a + 1) then 'page_' || a else 'pages_' || a || '-' || least(n, a + 1) end || '.pdf' file, (least(n, a + 1) - a + 1)::int pages from a""",
        "pdf_info": f"with {P} select doc_id, count(*)::int pages, false encrypted from p group by doc_id",
        "pdf_protected": f"with {P} select doc_id, true encrypted, count(*)::int pages from p group by doc_id",
        "pdf_compressed": f"""with {P}, f as (select distinct * exclude (ingested_at) from fragments) select doc_id, count(*) fragments, sum(length(text))::bigint characters from f join p using (doc_id, page_no)
            where text <> '' and x is not null and y is not null group by doc_id""",
        "docx_files": f"""with {P}, q as ({dup} from paragraphs), t as (select doc_id, {_strip("coalesce(array_to_string(list_transform(runs, lambda r: coalesce(r.text, '')), ''), '')")} s from q),
            n as (select doc_id, count(*) pages from p group by 1), c as (select doc_id, count(*) paragraphs, sum(case when s <> '' then len(regexp_extract_all(s, '[^{SPACE}]+')) else 0 end) words,
              sum(case when s <> '' then length(s) - length(replace(s, chr(10), '')) + 1 else 0 end) "lines", sum(length(s)) characters from t group by 1)
            select doc_id, doc_id || '.docx' file, pages::int pages, coalesce(paragraphs, 0)::int paragraphs, coalesce(words, 0)::int words, coalesce("lines", 0)::int "lines", coalesce(characters, 0)::int characters from n left join c using (doc_id)""",
        "list_levels": f"""with recursive {B}, {P}, {MARGINS}, {COLUMNS}, {PLACED}, {MARKED},
            it as (select pl.doc_id, pl.page_no, pl.block_idx, seq r, greatest(x_left - margin_left, 0.0) ind, case when {SHOWN} then kind end kind, format, punctuation, marker, case when kind = 'bullet' then kind else format || ':' || punctuation end kk
              from pl left join marks using (doc_id, page_no, block_idx)),
            lv as (select it.*, case when kind is null then []::struct(a double, k varchar)[] else [struct_pack(a := ind, k := kk)] end open, case when kind is not null then 0 end lvl from it where r = 1 union all
              select n.*, case when n.kind is null then []::struct(a double, k varchar)[] when len(list_filter(w.open, lambda o: o.k = n.kk and abs(n.ind - o.a) <= 6)) > 0 or len(w.open) >= 9 then w.open
                  else list_append(w.open, struct_pack(a := n.ind, k := n.kk)) end,
                case when n.kind is null then null when len(list_filter(w.open, lambda o: o.k = n.kk and abs(n.ind - o.a) <= 6)) > 0
                  then list_position(list_transform(w.open, lambda o: o.k = n.kk and abs(n.ind - o.a) <= 6), true) - 1 else least(len(w.open), 8) end
              from lv w join it n on n.doc_id = w.doc_id and n.r = w.r + 1)
            select doc_id, page_no, block_idx, kind, format, marker, lvl::int "level" from lv where kind is not null""",
        "proximity_clusters": f"""with recursive {B}, o as (select doc_id, page_no, block_idx, x_left xl, y_bottom yb, x_right xr, y_top yt, row_number() over (partition by doc_id, page_no order by {READ}) r
              from b where x_left is not null and y_bottom is not null and x_right is not null and y_top is not null),
            cl as (select *, 0 c, 1 n, [struct_pack(l := xl, d := yb, r := xr, u := yt, c := 0)] seen from o where r = 1 union all
              select o.*, coalesce(home, w.n), w.n + (home is null)::int, list_append(w.seen, struct_pack(l := o.xl, d := o.yb, r := o.xr, u := o.yt, c := coalesce(home, w.n)))
              from cl w join o on o.doc_id = w.doc_id and o.page_no = w.page_no and o.r = w.r + 1,
                lateral (select list_min(list_transform(list_filter(w.seen, lambda s: greatest(0, greatest(s.l, o.xl) - least(s.r, o.xr)) <= 36 and greatest(0, greatest(s.d, o.yb) - least(s.u, o.yt)) <= 36), lambda s: s.c)) home))
            select doc_id, page_no, block_idx, c cluster_no from cl""",
        "payload_dedup": "select sha256(text) digest, min(doc_id) doc_id, count(*) copies from documents where text is not null group by 1",
        "hyperlink_dedup": """with q as (select doc_id, page_no, para_idx, unnest(range(len(runs))) run_idx, unnest(runs) run from (select distinct * exclude (ingested_at) from paragraphs)),
            f as (select doc_id, run.hyperlink_target target, min((page_no, para_idx, run_idx)) first_at from q where run.hyperlink_target <> '' group by all)
            select doc_id, target, 'rId' || (row_number() over (partition by doc_id order by first_at, target) + 2) relation_id from f""",
        "split_ranges": f"""with {P}, r(part, a, z) as (values (0, 2, 3), (1, 1, 1), (2, 1, 2)) select doc_id, page, part, replace(doc_id, ' ', '_') || '_' || case when a = z then 'page_' || a else 'pages_' || a || '-' || z end || '.pdf' file
            from {N} join r on page between a and z""",
        "split_pages": f"with {P} select doc_id, page, case page when 1 then 0 else 1 end part from {N} where page in (1, 3)",
        "extract_pages": f"with {P} select doc_id, page, page - 1 new_page from {N} where page in (2, 3, 4)",
        "select_pages": f"with {P}, r(seq, n) as (values (0, 1), (1, 0), (2, 1)) select p.*, seq from p join r on page_no = n",
        "split_points": f"with {P} select doc_id, page, (page >= 2)::int + (page >= 4)::int part from {N}",
        "split_every_n": f"with {P} select doc_id, page, floor((page - 1) / 3)::int part from {N}",
        "split_all": f"with {P} select doc_id, page, page - 1 part from {N}",
        "merge_pages": f"""with {P}, q as (select *, substr(doc_id, 1, 10) "output" from {N}), s as (select "output", doc_id, count(*) n from q group by all),
            o as (select "output", doc_id, coalesce(sum(n) over (partition by "output" order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint "offset" from s)
            select q."output", q.doc_id, page, "offset", "offset" + row_number() over (partition by q."output", q.doc_id order by page) new_page from q join o using ("output", doc_id)""",
        "compression_info": f"""with {P}, n as (select doc_id pdf_id, count(*) images from p group by 1), d as (select d.doc_id, n_chars, coalesce(images, 0) images from documents d left join n using (pdf_id)),
            s as (select *, floor(n_chars * (case when images > 0 then least(0.35::double + 0.02::double * images, 0.6::double) else 0.05::double end))::bigint savings from d)
            select doc_id, images, savings, greatest(n_chars - (n_chars - savings), 0) bytes_saved, case when n_chars > 0 then round((n_chars - savings) / n_chars, 6) else 1.0 end ratio,
            case when n_chars < 1024 then printf('%.1f bytes', n_chars::double) when n_chars < 1048576 then printf('%.1f KiB', n_chars / 1024) when n_chars < 1073741824 then printf('%.1f MiB', n_chars / 1048576) else printf('%.1f GiB', n_chars / 1073741824) end size from s""",
        "page_units": f"with {P} select doc_id, page_no, round_even(width * 20, 0)::bigint twips, round_even(height * 12700, 0)::bigint emu, case when width > height then 'landscape' else 'portrait' end orientation from p",
        "cell_alignments": f"""with {B} select doc_id, page_no, block_idx, case when regexp_matches(replace(translate(text, ',·', ''), '−', '-'), '^\\s*[+-]?([0-9]+(_[0-9]+)*\\.?([0-9]+(_[0-9]+)*)?|\\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?\\s*$|^(?i)\\s*[+-]?(nan|inf|infinity)\\s*$') then 'right'
            when length(text) <= 3 and regexp_matches(text, '^\\p{{L}}+$') then 'center' else 'left' end alignment from b where block_role = 'TD'""",
        "page_report": f"""with {B}, {P}, s as (select doc_id, max(source) source from doc_metadata group by 1), q as (select doc_id, page_no, count(*) blocks, sum(length(text)) characters from b group by all)
            select source, case when grouping(o) = 0 then o end orientation, count(*) pages, sum(blocks)::bigint blocks, sum(characters)::bigint characters
            from (select p.*, case when width > height then 'landscape' else 'portrait' end o from p) left join q using (doc_id, page_no) left join s using (doc_id) group by rollup (source, o)""",
        "latest_records": "select doc_id, source, epoch_us(ingested_at) came_us from (select *, row_number() over (partition by doc_id order by ingested_at desc) rk from doc_metadata) where rk = 1",
    }
    return out
