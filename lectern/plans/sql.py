"""Pieces of DuckDB SQL that several oracle queries share."""

from __future__ import annotations

from ..functions.text import CONTENT_STOPWORDS, KEEP_FINAL_S, SUFFIXES, TERM_STOPWORDS


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def raw_terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[.,][0-9]+)*'), lambda w: length(w) >= 2 and w not in ({_list(TERM_STOPWORDS)}))"


def stem(w: str) -> str:
    out = f"case when regexp_matches({w}, '^[0-9]') then {w}"
    for s in SUFFIXES:
        keep = "".join(f" and not ends_with({w}, '{k}')" for k in KEEP_FINAL_S) if s == "s" else ""
        tail = " || 'y'" if s == "ies" else ""
        out += f" when ends_with({w}, '{s}') and length({w}) - {len(s)} >= 4{keep} then left({w}, length({w}) - {len(s)}){tail}"
    return out + f" else {w} end"


def content(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) > 2 and w not in ({_list(CONTENT_STOPWORDS)}))"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def sentences(text: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({squeeze(text)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 2)"


def overlap(q: str, t: str) -> str:
    qw, tw = f"list_distinct({content(q)})", f"list_distinct({content(t)})"
    return f"case when len({qw}) > 0 then len(list_intersect({qw}, {tw})) / len({qw}) else 0.0 end"


#: Postings of documents as units of one corpus, queries from the benchmark.
CORPUS = f"""
tok as (select unit, {stem('w')} as term from (select doc_id as unit, unnest({raw_terms('text')}) as w from documents)),
post as (select unit, term, count(*) as tf from tok group by all),
voc as (select term, count(*) as df, sum(tf) as tf from post group by term),
n as (select count(*) as n_units from documents),
len as (select unit, sum(tf) as len from post group by unit),
stat as (select n_units, (select sum(tf) from post) / n_units as avg_len from n),
qtok as (select query_id, pos, {stem('w')} as term from (select item_id as query_id, unnest({raw_terms('text')}) as w, generate_subscripts({raw_terms('text')}, 1) - 1 as pos from benchmark)),
qset as (select distinct query_id, term from qtok),
bm as (select q.query_id, p.unit, p.term, p.tf, l.len, s.avg_len, ln(1 + (n_units - df + 0.5) / (df + 0.5)) as idf from qset q join post p using (term) join voc v using (term) join len l using (unit), stat s),
bm25 as (select query_id, unit, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) as score from bm group by all),
bmrank as (select *, row_number() over (partition by query_id order by round(score, 9) desc, unit) as rank from bm25)"""

#: Unit-length TF-IDF weights and cosine scores on top of CORPUS.
COSINE = """
w0 as (select unit, term, (1 + ln(p.tf)) * (ln((1 + n_units) / (1 + df)) + 1) as weight from post p join voc v using (term), n),
nrm as (select unit, sqrt(sum(weight * weight)) as norm from w0 group by unit),
wt as (select unit, term, weight / norm as weight from w0 join nrm using (unit)),
q0 as (select query_id, term, (1 + ln(count(*))) * (ln((1 + any_value(n_units)) / (1 + any_value(df))) + 1) as qw from qtok join voc using (term), n group by query_id, term),
qn as (select query_id, sqrt(sum(qw * qw)) as norm from q0 group by query_id),
cos as (select query_id, unit, sum(qw / norm * weight) as score from q0 join qn using (query_id) join wt using (term) group by all),
cosrank as (select *, row_number() over (partition by query_id order by round(score, 9) desc, unit) as rank from cos)"""

#: A text with an outline: every third line opens a part, every sixth a section.
OUTLINE = """
o as (select doc_id, source, text as raw, '# Document ' || doc_id || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: case when (i - 1) % 3 = 0 then '## Part ' || cast(floor((i - 1) / 3) as bigint) || chr(10) || case when (i - 1) % 6 = 0 then '### Opening' || chr(10) else '' end || l else l end), chr(10)) as text from documents),
ol as (select doc_id, length(text) as n, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from o),
os as (select *, sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1 as char_start from ol),
oh as (select doc_id, n, row_number() over (partition by doc_id order by i) - 1 as idx, regexp_extract(line, '^#{1,6}\\s+(\\S.*?)\\s*$', 1) as title, length(regexp_extract(line, '^(#{1,6})\\s', 1)) as level, char_start from os where regexp_matches(trim(line), '^#{1,6}\\s+\\S')),
oe as (select a.doc_id, a.n, a.idx, any_value(a.title) as title, any_value(a.level) as level, any_value(a.char_start) as char_start, coalesce(min(b.char_start) filter (b.idx > a.idx and b.level <= a.level), a.n) as char_end, max(b.idx) filter (b.idx < a.idx and b.level < a.level) as parent_idx from oh a join oh b using (doc_id) group by a.doc_id, a.n, a.idx),
leaf as (select *, lpad(cast(idx + 1 as varchar), 4, '0') as node_id from oe x where not exists (select 1 from oe y where y.doc_id = x.doc_id and y.parent_idx = x.idx))"""

CHUNKS = """
c0 as (select doc_id, length({t}) as n, unnest(range(0, cast(ceil(greatest(length({t}) - {size}, 0) / {step}.0) as bigint) + 1)) as chunk_idx from {src} where length({t}) > 0),
c as (select doc_id, n, chunk_idx, chunk_idx * {step} as char_start, least(chunk_idx * {step} + {size}, n) as char_end from c0)"""


def chunks(src: str = "documents", text: str = "text", size: int = 800, overlap: int = 100) -> str:
    return CHUNKS.format(src=src, t=text, size=size, step=size - overlap)
