"""Registered queries over the operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T
from ..operators import assemble as A
from ..operators import chunk as C
from ..operators import clean as P
from ..operators import dense, retrieval as R
from ..operators import evaluate as E
from ..operators import outline as O
from ..operators import tree as TR
from ..operators import vectors as V
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def six(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


# ---- sources and loading


@query("select doc_id, cast(i + 1 as bigint) as page, array_to_string(l[i * 5 + 1 : (i + 1) * 5], chr(10)) as text from (select doc_id, string_split(text, chr(10)) as l, unnest(range(0, cast(floor((len(string_split(text, chr(10))) - 1) / 5) as bigint) + 1)) as i from documents)")
def paginate_lines(spark, d):
    return P.paginate(read(spark, d, "documents"), 5).select("doc_id", F.col("page").cast("long").alias("page"), "text")


@query("""with p as (select doc_id, i, array_to_string(l[i * 45 + 1 : (i + 1) * 45], chr(10)) as text from (select doc_id, string_split(text, chr(10)) as l, unnest(range(0, cast(floor((len(string_split(text, chr(10))) - 1) / 45) as bigint) + 1)) as i from documents))
select doc_id, count(*) as n_pages, cast(sum(length(text)) as bigint) as raw_chars, count(*) filter (trim(text, ' ' || chr(10)) = '') as n_empty from p group by doc_id""")
def load_stats(spark, d):
    return P.load_stats(P.paginate(read(spark, d, "documents"))).select("doc_id", "n_pages", "raw_chars", F.size("empty_pages").cast("long").alias("n_empty"))


# ---- cleaning


@query("""select doc_id, replace(replace(replace(replace(text, 'ff', 'ffi'), 'ti', 'fi'), ', ', '"-'), 'the ', 'the  ') as text from documents""")
def char_normalise(spark, d):
    """Glyphs are put in first: a ligature, quotes and dashes, a no-break and a zero-width space."""
    t = F.replace(F.replace(F.replace(F.replace("text", F.lit("ff"), F.lit("ﬃ")), F.lit("ti"), F.lit("ﬁ​")), F.lit(", "), F.lit("“—")), F.lit("the "), F.lit("the  "))
    return read(spark, d, "documents").select("doc_id", T.normalise(t).alias("text"))



@query("select doc_id, regexp_replace(trim('  Item ' || doc_id || ' of ' || source || ' p' || n_chars || ' '), '\\d+', '#', 'g') as key from documents")
def digit_blind(spark, d):
    line = F.concat(F.lit("  Item "), F.col("doc_id"), F.lit(" of "), F.col("source"), F.lit(" p"), F.col("n_chars"), F.lit(" "))
    return read(spark, d, "documents").select("doc_id", T.digit_blind(line).alias("key"))


@query("select doc_id, cast(floor(length(text) / 4) + 1 as bigint) as tokens from documents")
def estimate_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@query("select doc_id, regexp_replace(replace(text, ' ', chr(9) || '  '), '[ \\t]{2,}', ' ', 'g') as text from documents")
def collapse_spaces(spark, d):
    return read(spark, d, "documents").select("doc_id", T.collapse_spaces(F.replace("text", F.lit(" "), F.lit("\t  "))).alias("text"))


@query(f"select doc_id, {S.squeeze('text')} as text from documents")
def squeeze_spaces(spark, d):
    return read(spark, d, "documents").select("doc_id", T.squeeze("text").alias("text"))


_BROKEN_SQL = "replace(replace(text, ' the ', ' th-' || chr(10) || 'e '), ' of ', ' One-' || chr(10) || 'time ')"


@query(f"select doc_id, replace(regexp_replace(replace({_BROKEN_SQL}, 'One-' || chr(10) || 'time', 'One' || chr(2) || 'time'), '([A-Za-z0-9_]+)-\\n([A-Za-z0-9_]+)', '\\1\\2', 'g'), chr(2), '-') as text from documents")
def dehyphenate(spark, d):
    t = F.replace(F.replace("text", F.lit(" the "), F.lit(" th-\ne ")), F.lit(" of "), F.lit(" One-\ntime "))
    return read(spark, d, "documents").select("doc_id", T.dehyphenate(t).alias("text"))


@query("select doc_id, cast((length(text) - length(replace(text, ' of ', ''))) / 4 as bigint) as kept, cast((length(text) - length(replace(text, ' the ', ''))) / 5 as bigint) as joined from documents")
def hyphen_decisions(spark, d):
    t = F.replace(F.replace("text", F.lit(" the "), F.lit(" th-\ne ")), F.lit(" of "), F.lit(" One-\ntime "))
    out = read(spark, d, "documents").select("doc_id", T.hyphen_decisions(t).alias("h"))
    n = lambda a: F.size(F.filter("h", lambda x: x["action"] == a)).cast("long")
    return out.select("doc_id", n("kept hyphen").alias("kept"), n("joined").alias("joined"))


def paged(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of five lines between a running header and a numbered footer."""
    docs = read(spark, d, "documents")
    p = P.paginate(docs, 5).join(docs.select("doc_id", "source"), "doc_id")
    return p.select("doc_id", "page", F.concat(F.lit("Notes of "), "source", F.lit("\n"), "text", F.lit("\nPage "), "page", F.lit(" end")).alias("text"))


_PAGED = """
pg as (select doc_id, i + 1 as page, 'Notes of ' || source || chr(10) || array_to_string(l[i * 5 + 1 : (i + 1) * 5], chr(10)) || chr(10) || 'Page ' || (i + 1) || ' end' as text
  from (select doc_id, source, string_split(text, chr(10)) as l, unnest(range(0, cast(floor((len(string_split(text, chr(10))) - 1) / 5) as bigint) + 1)) as i from documents)),
np as (select doc_id, count(*) as n from pg group by doc_id),
ed as (select doc_id, page, unnest(list_distinct([l[1], l[-1]])) as line from (select doc_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as l from pg)),
fu as (select doc_id, regexp_replace(line, '\\d+', '#', 'g') as key from ed group by all),
fk as (select e.doc_id, regexp_replace(line, '\\d+', '#', 'g') as key, count(*) as c from ed e group by all),
fur as (select doc_id, key from fk join np using (doc_id) where c >= greatest(3, ceil(0.5 * n)))"""


@query(f"with {_PAGED} select doc_id, key from fur")
def furniture(spark, d):
    return P.detect_furniture(paged(spark, d))


@query(f"with {_PAGED}, ln as (select doc_id, page, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from pg) select doc_id, page, coalesce(string_agg(l, chr(10) order by i) filter (not exists (select 1 from fur where fur.doc_id = ln.doc_id and fur.key = regexp_replace(trim(l), '\\d+', '#', 'g'))), '') as text from ln group by doc_id, page")
def strip_furniture(spark, d):
    p = paged(spark, d)
    return P.with_furniture(p, P.detect_furniture(p)).select("doc_id", F.col("page").cast("long").alias("page"), P.strip_furniture("text", "furniture").alias("text"))


_MARKED = "regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10)), '(Th|An|In)', 'A.1 \\1')"


@query(f"""with b as (select doc_id, unnest(string_split({_MARKED}, chr(10))) as l, generate_subscripts(string_split({_MARKED}, chr(10)), 1) as i from documents),
f as (select doc_id, i, trim(l) as s, trim(l) = '' as blank, regexp_matches(trim(l), '^[A-Z]\\.\\d+(?:\\.\\d+)*\\s+\\S') and length(trim(l)) <= 95 as h from b),
g as (select *, sum(case when blank or h then 1 else 0 end) over (partition by doc_id order by i) + coalesce(sum(case when h then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as block from f),
k as (select doc_id, block, string_agg(s, ' ' order by i) as s, min(i) as i from g where not blank group by all)
select d.doc_id, coalesce(string_agg(s, chr(10) || chr(10) order by i), '') as text from documents d left join k using (doc_id) group by d.doc_id""")
def unwrap_paragraphs(spark, d):
    """Sentence ends become paragraph ends, and the first of some syllables a heading number, before unwrapping."""
    t = F.regexp_replace(F.replace("text", F.lit(". "), F.lit(".\n\n")), "^(?s)(.*?)(Th|An|In)", "$1A.1 $2")
    return read(spark, d, "documents").select("doc_id", P.unwrap(t).alias("text"))


@query("""with p as (select doc_id, i + 1 as page, array_to_string(list_transform(l[i * 5 + 1 : (i + 1) * 5], lambda x: case when doc_id % 3 = 0 then x || ' . . . . ' || doc_id else x end), chr(10)) as text from (select doc_id, string_split(text, chr(10)) as l, unnest(range(0, cast(floor((len(string_split(text, chr(10))) - 1) / 5) as bigint) + 1)) as i from documents))
select doc_id, page, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 4 and len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' and regexp_matches(x, '(?:\\.\\s*){3,}'))) > 0.5 * len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as toc from p""")
def toc_pages(spark, d):
    """Every third document gets dot leaders at its line ends."""
    p = P.paginate(read(spark, d, "documents"), 5)
    lead = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.col("doc_id") % 3 == 0, F.concat(x, F.lit(" . . . . "), F.col("doc_id"))).otherwise(x)), "\n")
    return p.select("doc_id", F.col("page").cast("long").alias("page"), H.is_toc(lead).alias("toc"))


@query("""with p as (select doc_id, i + 1 as page, array_to_string(l[i * 3 + 1 : (i + 1) * 3], chr(10)) as text from (select doc_id, string_split(replace(text, 'A', 'a'), chr(10)) as l, unnest(range(0, cast(floor((len(string_split(text, chr(10))) - 1) / 3) as bigint) + 1)) as i from documents)),
q as (select *, lag(text) over (partition by doc_id order by page) as before from p)
select doc_id, page, coalesce(length(before) > 0 and length(text) > 0 and not regexp_matches(rtrim(before, ' ' || chr(10)), '[.!?:;]$') and regexp_matches(ltrim(text, ' ' || chr(10)), '^\\p{Ll}'), false) as joined from q""")
def page_continuations(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.replace("text", F.lit("A"), F.lit("a")).alias("text"))
    p = P.paginate(docs, 3)
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("page"))
    return p.select("doc_id", F.col("page").cast("long").alias("page"), P.continues(before, F.col("text")).alias("joined"))


@query()
def pages_per_page(spark, d):
    """Strategy A: each page cleaned alone."""
    return P.parse_per_page(paged(spark, d))


@query()
def merged_documents(spark, d):
    """Strategy B: pages cleaned and joined into one text."""
    return P.merge(P.merged_spans(paged(spark, d)))


@query()
def page_spans(spark, d):
    return P.merged_spans(paged(spark, d)).select("doc_id", "page", "char_start", "char_end")


# ---- headings and outline

_HEADLINE = {
    "dotted_alpha": ("'A.' || doc_id % 9 || '.' || doc_id % 5 || ' ' || left(text, 20)", "^([A-Z]\\.\\d+(?:\\.\\d+)*)\\s+(\\S.*?)\\s*$"),
    "markdown": ("repeat('#', cast(1 + doc_id % 6 as int)) || ' ' || left(text, 20)", "^(#{1,6})\\s+(\\S.*?)\\s*$"),
}


@query(f"""with l as (select doc_id, trim(regexp_replace(left(text, 20), '\\s+', ' ', 'g')) as t from documents),
a as (select doc_id, 'dotted_alpha' as scheme, 'A.' || doc_id % 9 || '.' || doc_id % 5 as number, t as title, 2 as level from l where t <> ''),
m as (select doc_id, 'markdown' as scheme, cast(null as varchar) as number, t as title, cast(1 + doc_id % 6 as int) as level from l where t <> ''),
k as (select doc_id, 'chapter' as scheme, 'Part ' || doc_id as number, t as title, 1 as level from l where t <> '')
select * from a union all select * from m union all select * from k""")
def heading_matches(spark, d):
    t = T.squeeze(F.substring("text", 1, 20))
    docs = read(spark, d, "documents").select("doc_id", t.alias("t")).where("t <> ''")
    lines = {
        "dotted_alpha": F.concat(F.lit("A."), F.col("doc_id") % 9, F.lit("."), F.col("doc_id") % 5, F.lit(" "), F.col("t")),
        "markdown": F.concat(F.repeat(F.lit("#"), (1 + F.col("doc_id") % 6).cast("int")), F.lit(" "), F.col("t")),
        "chapter": F.concat(F.lit("Part "), F.col("doc_id"), F.lit(": "), F.col("t")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("scheme"), H.SCHEMES[k](v).alias("h")) for k, v in lines.items()])).alias("x")
    return docs.select("doc_id", rows).select("doc_id", "x.scheme", "x.h.number", "x.h.title", "x.h.level").where("level is not null")


def outlined(spark: SparkSession, d: str) -> DataFrame:
    """Documents with markdown headings put in: every third line opens a part, every sixth a section."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## Part "), F.floor(i / 3).cast("string"), F.lit("\n"), F.when(i % 6 == 0, F.lit("### Opening\n")).otherwise(F.lit("")), x)).otherwise(x),
    )
    return read(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("# Document "), "doc_id", F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


@query(f"""with {S.OUTLINE}, s as (select doc_id, 'markdown' as scheme, count(*) as hits, count(distinct level) as levels from oh group by doc_id)
select doc_id, hits, levels, hits * greatest(levels, 1) as score, case when hits >= 3 then 'markdown' end as scheme from s""")
def scheme_scores(spark, d):
    lines = outlined(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    s = P.score_schemes(lines)
    return s.where("scheme = 'markdown'").select("doc_id", "hits", "levels", "score").join(P.detect_scheme(s), "doc_id")


@query(f"with {S.OUTLINE} select doc_id, cast(idx as bigint) as heading_idx, title, cast(level as bigint) as level, cast(char_start as bigint) as char_start from oh")
def outline_headings(spark, d):
    return O.find_headings(outlined(spark, d)).select("doc_id", F.col("heading_idx").cast("long").alias("heading_idx"), "title", F.col("level").cast("long").alias("level"), F.col("char_start").cast("long").alias("char_start"))


@query(f"with {S.OUTLINE} select doc_id, cast(idx as bigint) as heading_idx, cast(char_start as bigint) as char_start, cast(char_end as bigint) as char_end, cast(parent_idx as bigint) as parent_idx from oe")
def outline_spans(spark, d):
    s = O.assign_spans(O.find_headings(outlined(spark, d)))
    return s.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("heading_idx", "char_start", "char_end", "parent_idx")])


@query(f"""with {S.OUTLINE} select doc_id, '0000' as node_id, cast(null as varchar) as parent_id, source as title, false as is_leaf from o
union all select oe.doc_id, lpad(cast(idx + 1 as varchar), 4, '0'), coalesce(lpad(cast(parent_idx + 1 as varchar), 4, '0'), '0000'), title, not exists (select 1 from oe y where y.doc_id = oe.doc_id and y.parent_idx = oe.idx) from oe""")
def outline_nodes(spark, d):
    docs = outlined(spark, d)
    return O.build_tree(O.find_headings(docs), docs).select("doc_id", "node_id", "parent_id", "title", "is_leaf")


def _fixed_pages(docs: DataFrame, size: int = 1000) -> DataFrame:
    n = F.length("text")
    return docs.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("i")).select("doc_id", (F.col("i") + 1).alias("page"), (F.col("i") * size).alias("char_start"), F.least((F.col("i") + 1) * size, F.col("n")).alias("char_end"))


@query(f"with {S.OUTLINE} select doc_id, node_id, cast(floor(char_start / 1000) + 1 as bigint) as start_page, cast(floor((char_end - 1) / 1000) + 1 as bigint) as end_page from leaf")
def section_pages(spark, d):
    """Pages of 1,000 characters that each leaf section overlaps."""
    docs = outlined(spark, d)
    leaves = E.sections(O.build_tree(O.find_headings(docs), docs)).select("doc_id", "node_id", "char_start", "char_end")
    out = O.with_pages(leaves, _fixed_pages(docs), ["doc_id", "node_id"])
    return out.select("doc_id", "node_id", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"))


# ---- chunks


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) for c in cols])


@query(f"with {S.chunks()} select doc_id, cast(chunk_idx as bigint) as chunk_idx, cast(char_start as bigint) as char_start, cast(char_end as bigint) as char_end from c")
def chunks_fixed(spark, d):
    return _long(C.fixed(read(spark, d, "documents")), "doc_id", "chunk_idx", "char_start", "char_end")


@query()
def chunks_recursive(spark, d):
    return C.recursive(read(spark, d, "documents"))


@query(f"with {S.OUTLINE}, e as (select doc_id, char_start, lead(char_start) over (partition by doc_id order by char_start) as nxt, n from oh) select doc_id, cast(row_number() over (partition by doc_id order by char_start) - 1 as bigint) as chunk_idx, cast(char_start as bigint) as char_start, cast(coalesce(nxt, n) as bigint) as char_end from e")
def chunks_structural(spark, d):
    """Sections of any length are whole chunks here."""
    docs = outlined(spark, d)
    return _long(C.structural(docs, O.find_headings(docs), 1_000_000_000, 0), "doc_id", "chunk_idx", "char_start", "char_end")


@query()
def chunks_structural_cut(spark, d):
    docs = outlined(spark, d)
    return C.structural(docs, O.find_headings(docs), 800, 100)


@query(f"with {S.chunks()} select doc_id, format('c{{:04d}}', chunk_idx) as chunk_id, substring(text, chunk_idx * 700 + 1, least(800, n - chunk_idx * 700)) as text from c join documents using (doc_id)")
def chunk_rows(spark, d):
    docs = read(spark, d, "documents")
    return C.to_rows(C.fixed(docs), docs, "fixed").select("doc_id", "chunk_id", "text")


# ---- terms and vectors


def corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(documents as units of one scope, benchmark items as queries)."""
    units = read(spark, d, "documents").select(F.lit(0).alias("scope"), F.col("doc_id").alias("unit"), "text")
    return units, read(spark, d, "benchmark").select(F.lit(0).alias("scope"), F.col("item_id").alias("query_id"), "text")


@query(f"with t as (select doc_id, {S.raw_terms('text')} as l from documents) select doc_id, cast(len(l) as bigint) as n_terms, cast(len(list_distinct(list_transform(l, lambda w: {S.stem('w')}))) as bigint) as n_distinct from t")
def terms_per_doc(spark, d):
    t = V.terms(read(spark, d, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.count_distinct("term").alias("n_distinct"))
    return read(spark, d, "documents").select("doc_id").join(t, "doc_id", "left").fillna(0)


@query(f"with {S.CORPUS} select term, df, cast(tf as bigint) as tf, round(ln((1 + n_units) / (1 + df)) + 1, 6) as idf from voc, n")
def vocabulary(spark, d):
    units, _ = corpus(spark, d)
    post = V.postings(units)
    return V.vocabulary(post, V.scope_stats(units, post)).select("term", "df", "tf", six("idf"))


@query(f"with {S.CORPUS}, r as (select term, df, round(ln((1 + n_units) / (1 + df)) + 1, 6) as idf, row_number() over (order by round(tf * (ln((1 + n_units) / (1 + df)) + 1), 9) desc, term) as rank from voc, n) select * from r where rank <= 12")
def most_informative(spark, d):
    units, _ = corpus(spark, d)
    post = V.postings(units)
    return V.informative(V.vocabulary(post, V.scope_stats(units, post))).select("term", "df", six("idf"), F.col("rank").cast("long").alias("rank"))


@query(f"with {S.CORPUS}, r as (select term, df, row_number() over (order by df desc, term) as rank from voc) select * from r where rank <= 5")
def most_common(spark, d):
    units, _ = corpus(spark, d)
    post = V.postings(units)
    return V.common(V.vocabulary(post, V.scope_stats(units, post))).select("term", "df", F.col("rank").cast("long").alias("rank"))


@query(f"with {S.CORPUS} select query_id, term, min(pos) as first_pos from qtok where term not in (select term from voc where df >= 5) group by all")
def unknown_terms(spark, d):
    units, queries = corpus(spark, d)
    post = V.postings(units)
    vocab = V.vocabulary(post, V.scope_stats(units, post), min_df=5)
    return V.unknown_terms(queries, vocab).select("query_id", "term", F.col("first_pos").cast("long").alias("first_pos"))


@query(f"with {S.CORPUS} select unit as doc_id, count(*) as n_terms, cast(sum(p.tf) as bigint) as n_tokens from post p join voc v using (term) where df >= 3 and df <= 0.5 * (select n_units from n) group by unit")
def term_counts(spark, d):
    """Counts within a vocabulary cut at both ends."""
    units, _ = corpus(spark, d)
    post = V.postings(units)
    vocab = V.vocabulary(post, V.scope_stats(units, post), min_df=3, max_df_ratio=0.5)
    return post.join(vocab.select("scope", "term"), ["scope", "term"], "left_semi").groupBy(F.col("unit").alias("doc_id")).agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"))


@query(f"with {S.CORPUS} select unit as doc_id, cast(coalesce(sum(tf) filter (term = 'tion'), 0) as bigint) as tion, cast(coalesce(sum(tf) filter (term = 'hand'), 0) as bigint) as hand, cast(coalesce(sum(tf) filter (term = 'onou'), 0) as bigint) as onou from post where term in ('tion', 'hand', 'onou') group by unit")
def term_matrix(spark, d):
    units, _ = corpus(spark, d)
    post = V.postings(units).where(F.col("term").isin("tion", "hand", "onou"))
    return V.term_matrix(post, ["tion", "hand", "onou"]).select(F.col("unit").alias("doc_id"), "tion", "hand", "onou")


@query(f"with {S.CORPUS}, {S.COSINE}, r as (select unit as doc_id, term, round(weight, 6) as weight, row_number() over (partition by unit order by round(weight, 9) desc, term) as rank from wt) select * from r where rank <= 5")
def heaviest_terms(spark, d):
    units, _ = corpus(spark, d)
    post = V.postings(units)
    w = V.l2(V.tfidf(post, V.vocabulary(post, V.scope_stats(units, post))))
    return V.explain(w, 5).select(F.col("unit").alias("doc_id"), "term", six("weight"), F.col("rank").cast("long").alias("rank"))


@query(f"with {S.CORPUS}, {S.COSINE} select query_id, unit as doc_id, round(score, 6) as score, rank from cosrank where rank <= 5")
def cosine_topk(spark, d):
    units, queries = corpus(spark, d)
    post = V.postings(units)
    vocab = V.vocabulary(post, V.scope_stats(units, post))
    s = R.cosine_scores(queries, V.l2(V.tfidf(post, vocab)), vocab)
    return R.ranked(s, 5).select("query_id", F.col("unit").alias("doc_id"), six("score"), F.col("rank").cast("long").alias("rank"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
s as (select q.vec_id as query_id, v.vec_id as unit, round(list_cosine_similarity(q.e, v.e), 9) as score from v q, v where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, unit) as rank from s) select query_id, unit, round(score, 6) as score, rank from r where rank <= 5""")
def embedding_topk(spark, d):
    """Every fiftieth vector against all."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), F.col("embedding").alias("vec"))
    q = v.where(F.col("unit") % 50 == 0).select(F.col("unit").alias("query_id"), "vec")
    return dense.top_k(v, q, 5).select("query_id", "unit", six("score"), F.col("rank").cast("long").alias("rank"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings)
select a.vec_id, round(list_inner_product(a.e, b.e), 6) as dot, round(list_cosine_similarity(a.e, b.e), 6) as cosine, round(degrees(acos(greatest(-1, least(1, list_cosine_similarity(a.e, b.e))))), 4) as angle, round(list_distance(a.e, b.e), 6) as distance from v a join v b on b.vec_id = a.vec_id + 1""")
def vector_algebra(spark, d):
    """Each vector and the next."""
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    j = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return j.select("vec_id", F.round(V.dot(a, b), 6).alias("dot"), F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.angle(V.cosine(a, b)), 4).alias("angle"), F.round(V.euclidean(a, b), 6).alias("distance"))


_LOCAL = f"""
{S.chunks()},
lt as (select doc_id as scope, chunk_idx as unit, {S.stem('w')} as term from (select doc_id, chunk_idx, unnest({S.raw_terms('substring(text, char_start + 1, char_end - char_start)')}) as w from c join documents using (doc_id))),
lp as (select scope, unit, term, count(*) as tf from lt group by all),
ln as (select doc_id as scope, count(*) as n from c group by doc_id),
lv as (select scope, term, count(*) as df from lp group by all),
lw as (select scope, unit, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as w from lp join lv using (scope, term) join ln using (scope)),
lu as (select scope, unit, term, w / sqrt(sum(w * w) over (partition by scope, unit)) as w from lw),
pr as (select a.scope, a.unit as a, b.unit as b, sum(a.w * b.w) as score from lu a join lu b on a.scope = b.scope and a.term = b.term and a.unit < b.unit group by all),
cp as (select *, row_number() over (partition by scope order by round(score, 9) desc, a, b) as r from pr)"""


def _local_weights(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents")
    units = C.to_rows(C.fixed(docs), docs, "fixed").select(F.col("doc_id").alias("scope"), F.col("chunk_idx").cast("long").alias("unit"), "text")
    post = V.postings(units)
    return units, V.l2(V.tfidf(post, V.vocabulary(post, V.scope_stats(units, post))))


@query(f"with {_LOCAL} select scope as doc_id, a, b, round(score, 6) as score from cp where r = 1")
def closest_chunks(spark, d):
    """The two most similar chunks of each document, with statistics of that document."""
    return V.closest_pair(_local_weights(spark, d)[1]).select(F.col("scope").alias("doc_id"), "a", "b", six("score"))


@query(f"with {_LOCAL}, k as (select cp.scope, cp.a, cp.b, x.term, x.w * y.w as product, row_number() over (partition by cp.scope order by round(x.w * y.w, 9) desc, x.term) as rank from cp join lu x on x.scope = cp.scope and x.unit = cp.a join lu y on y.scope = cp.scope and y.unit = cp.b and y.term = x.term where r = 1) select scope as doc_id, term, round(product, 6) as product, rank from k where rank <= 5")
def shared_terms(spark, d):
    w = _local_weights(spark, d)[1]
    return V.shared_terms(w, V.closest_pair(w)).select(F.col("scope").alias("doc_id"), "term", six("product"), F.col("rank").cast("long").alias("rank"))


@query()
def svd_components(spark, d):
    """Labels of the components of each document's chunks."""
    w = _local_weights(spark, d)[1]
    return V.explain_components(V.svd(w, 4)).withColumnRenamed("scope", "doc_id")


# ---- ranking


def _bm25(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    units, queries = corpus(spark, d)
    post = V.postings(units)
    return units, queries, post, V.scope_stats(units, post)


@query(f"with {S.CORPUS} select query_id, unit as doc_id, round(score, 6) as score, rank from bmrank where rank <= 5")
def bm25_topk(spark, d):
    _, queries, post, stats = _bm25(spark, d)
    return R.ranked(R.bm25_scores(queries, post, stats), 5).select("query_id", F.col("unit").alias("doc_id"), six("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {S.CORPUS}, top as (select query_id, unit from bmrank where rank = 1)
select q.query_id, t.unit as doc_id, q.term, cast(coalesce(b.tf, 0) as bigint) as freq, round(ln(1 + (n_units - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 6) as idf, round(coalesce(b.idf * b.tf * 2.5 / (b.tf + 1.5 * (0.25 + 0.75 * len / avg_len)), 0), 6) as part
from qset q join top t using (query_id) left join bm b on b.query_id = q.query_id and b.unit = t.unit and b.term = q.term left join voc v on v.term = q.term, n""")
def bm25_explain(spark, d):
    _, queries, post, stats = _bm25(spark, d)
    top = R.ranked(R.bm25_scores(queries, post, stats), 1)
    return R.bm25_explain(queries, post, stats, top).select("query_id", F.col("unit").alias("doc_id"), "term", "freq", six("idf"), six("part"))


VARIANTS = [(1.5, 0.75), (0.5, 0.75), (3.0, 0.75), (1.5, 0.0), (1.5, 1.0)]


@query(f"""with {S.CORPUS}, v(variant, k1, b) as (values {", ".join(f"({i}, {k}, {b})" for i, (k, b) in enumerate(VARIANTS))}),
s as (select variant, query_id, unit, sum(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg_len))) as score from bm, v group by all),
r as (select *, row_number() over (partition by variant, query_id order by round(score, 9) desc, unit) as rank from s)
select cast(variant as bigint) as variant, query_id, unit as doc_id, round(score, 6) as score, rank from r where rank <= 3""")
def bm25_sweep(spark, d):
    _, queries, post, stats = _bm25(spark, d)
    return R.bm25_sweep(queries, post, stats, VARIANTS).select(F.col("variant").cast("long").alias("variant"), "query_id", F.col("unit").alias("doc_id"), six("score"), F.col("rank").cast("long").alias("rank"))


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """units, queries, and the whole rankings by BM25 and by cosine."""
    units, queries, post, stats = _bm25(spark, d)
    vocab = V.vocabulary(post, stats)
    return units, queries, R.ranked(R.bm25_scores(queries, post, stats)), R.ranked(R.cosine_scores(queries, V.l2(V.tfidf(post, vocab)), vocab))


_FUSED = f"""{S.CORPUS}, {S.COSINE},
rb as (select * from bmrank), rc as (select * from cosrank),
fu as (select query_id, unit, sum(1.0 / (60 + rank)) as score from (select query_id, unit, rank from rb union all select query_id, unit, rank from rc) group by all),
fr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, unit) as rank from fu)"""


@query(f"with {_FUSED} select query_id, unit as doc_id, round(score, 6) as score, rank from fr where rank <= 10")
def rrf_topk(spark, d):
    _, _, b, c = _both(spark, d)
    return R.ranked(R.rrf([(b, 1.0), (c, 1.0)]), 10).select("query_id", F.col("unit").alias("doc_id"), six("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_FUSED}, j as (select rb.query_id, rb.unit, rb.rank as a, rc.rank as b from rb join rc using (query_id, unit)) select query_id, count(*) as both, cast(max(abs(a - b)) as bigint) as widest, count(*) filter (a <= 5 and b <= 5) as agreed, 100.0 * count(*) filter (a <= 5 and b <= 5) / 5 as agreement from j group by query_id")
def rank_disagreement(spark, d):
    _, _, b, c = _both(spark, d)
    gaps, agree = R.disagreement(b, c, 5)
    return gaps.groupBy("query_id").agg(F.count("*").alias("both"), F.max("gap").cast("long").alias("widest")).join(agree, "query_id")


_RERANK = f"""{_FUSED},
rw as (select f.query_id, f.unit, list_distinct({S.content('b.text')}) as q, {S.content('d.text')} as w from fr f join benchmark b on b.item_id = f.query_id join documents d on d.doc_id = f.unit where f.rank <= 10),
rx as (select query_id, unit, len(q) as nq, len(w) as nw, q, unnest(w) as x, generate_subscripts(w, 1) as pos from rw),
rh as (select query_id, unit, nq, nw, count(distinct x) as m, count(*) as hits, min(pos) as lo, max(pos) as hi from rx where list_contains(q, x) group by all),
rs as (select w.query_id, w.unit, coalesce(2.0 * m / nq + 0.5 * hits / sqrt(nw) + case when m > 1 then m / (hi - lo + 1) else 0.5 end, 0) as score from rw w left join rh using (query_id, unit)),
rr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, unit) as rank from rs)"""


@query(f"with {_RERANK} select query_id, unit as doc_id, round(score, 6) as score, rank from rr")
def rerank(spark, d):
    units, queries, b, c = _both(spark, d)
    short = R.ranked(R.rrf([(b, 1.0), (c, 1.0)]), 10)
    return R.ranked(R.rerank_scores(short, queries, units)).select("query_id", F.col("unit").alias("doc_id"), six("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_RERANK} select rr.query_id, rr.unit as doc_id, rc.rank as cosine_rank, rb.rank as bm25_rank, fr.rank as fused_rank, rr.rank as final_rank, rr.rank < fr.rank as promoted from rr join fr using (query_id, unit) left join rc using (query_id, unit) left join rb using (query_id, unit)")
def stage_movement(spark, d):
    units, queries, b, c = _both(spark, d)
    fused = R.ranked(R.rrf([(b, 1.0), (c, 1.0)]), 10)
    final = R.ranked(R.rerank_scores(fused, queries, units))
    name = lambda df, n: df.select("query_id", "unit", F.col("rank").cast("long").alias(n))
    out = name(final, "final_rank").join(name(fused, "fused_rank"), ["query_id", "unit"]).join(name(c, "cosine_rank"), ["query_id", "unit"], "left").join(name(b, "bm25_rank"), ["query_id", "unit"], "left")
    return out.select("query_id", F.col("unit").alias("doc_id"), "cosine_rank", "bm25_rank", "fused_rank", "final_rank", (F.col("final_rank") < F.col("fused_rank")).alias("promoted"))


@query(f"with {S.CORPUS} select query_id, unit as doc_id, rank from bmrank join documents on doc_id = unit where rank <= 10 and lang = 'en'")
def post_filter(spark, d):
    _, queries, post, stats = _bm25(spark, d)
    lang = read(spark, d, "documents").select(F.col("doc_id").alias("unit"), "lang")
    r = R.ranked(R.bm25_scores(queries, post, stats), 10).join(lang, "unit")
    return R.post_filter(r, F.col("lang") == "en", 10).select("query_id", F.col("unit").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


@query(f"with {S.CORPUS}, r as (select query_id, unit as doc_id, row_number() over (partition by query_id order by round(score, 9) desc, unit) as rank from bm25 join documents on doc_id = unit where lang = 'en') select * from r where rank <= 10")
def pre_filter(spark, d):
    _, queries, post, stats = _bm25(spark, d)
    lang = read(spark, d, "documents").select(F.col("doc_id").alias("unit"), "lang")
    s = R.bm25_scores(queries, post, stats).join(lang, "unit")
    return R.pre_filter(s, F.col("lang") == "en", 10).select("query_id", F.col("unit").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


@query("select label, count(*) as n, cast(count(*) * 64 as double) as ops, count(*) * 64 / 2e9 as seconds, count(*) * 64 * 4 / 1e6 as mb from embeddings group by label")
def index_cost(spark, d):
    n = read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.select("label", "n", *R.index_cost(F.col("n"), F.lit(64)))


@query("select n, cast(n * 96 as double) as ops, n * 96 / 2e9 as seconds, n * 96 * 4 / 1e6 as mb from (values (1000::bigint), (100000::bigint), (10000000::bigint)) t(n)")
def scale_table(spark, d):
    return spark.createDataFrame([(1000,), (100_000,), (10_000_000,)], "n long").select("n", *R.index_cost(F.col("n"), F.lit(96)))


@query("select * from (values " + ", ".join(str(x) for x in R.INDEX_TYPES) + ") t(kind, builds, recall, cost)")
def index_types(spark, d):
    return spark.createDataFrame(R.INDEX_TYPES, "kind string, builds string, recall string, cost string")


# ---- evaluation

_REL = f"{S.CORPUS}, rk as (select query_id, unit, rank from bmrank), rel as (select distinct item_id as query_id, doc_id as unit from benchmark b join documents d on b.text <> '' and contains(d.text, b.text))"


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(the full ranking by BM25, all documents that hold the item's text)."""
    units, queries, post, stats = _bm25(spark, d)
    return R.ranked(R.bm25_scores(queries, post, stats)), E.holding(units, queries, post)


_CASES = f"""{_REL},
nr as (select query_id, count(*) as n_relevant from rel group by query_id),
pc as (select n.query_id, n_relevant, count(*) filter (r.rank <= 5 and rel.unit is not null) as hits, count(*) filter (r.rank <= 5) as returned, min(r.rank) filter (rel.unit is not null) as first_rank, coalesce(sum(1 / log2(r.rank + 1)) filter (r.rank <= 5 and rel.unit is not null), 0) as dcg
  from nr n left join rk r using (query_id) left join rel on rel.query_id = r.query_id and rel.unit = r.unit group by all),
pm as (select query_id, n_relevant, hits, first_rank, hits / n_relevant as recall, case when returned > 0 then hits / returned else 0 end as precision, coalesce(1.0 / first_rank, 0) as reciprocal_rank, case when hits > 0 then 1.0 else 0.0 end as hit, dcg / list_sum(list_transform(range(1, least(n_relevant, 5) + 1), lambda i: 1 / log2(i + 1))) as ndcg from pc)"""


@query(f"with {_CASES} select query_id, n_relevant, hits, first_rank, round(recall, 6) as recall, round(precision, 6) as precision, round(reciprocal_rank::double, 6) as reciprocal_rank, hit::double as hit, round(ndcg, 6) as ndcg from pm")
def retrieval_cases(spark, d):
    r, rel = _judged(spark, d)
    return E.per_case(r, rel, 5).select("query_id", "n_relevant", "hits", F.col("first_rank").cast("long").alias("first_rank"), six("recall"), six("precision"), six("reciprocal_rank"), "hit", six("ndcg"))


@query(f"with {_CASES} select count(*) as n_cases, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(coalesce(1.0 / first_rank, 0))::double, 6) as reciprocal_rank, round(avg(hit)::double, 6) as hit, round(avg(ndcg), 6) as ndcg from pm")
def retrieval_metrics(spark, d):
    r, rel = _judged(spark, d)
    return E.evaluate(E.per_case(r, rel, 5)).select("n_cases", *[six(c) for c in ("recall", "precision", "reciprocal_rank", "hit", "ndcg")])


@query(f"with {_REL}, nr as (select query_id, count(*) as n from rel group by query_id), ks(k) as (values (1::bigint), (2), (3), (5), (10)) select query_id, k, round(count(rel.unit) filter (r.rank <= k) / any_value(n), 6) as recall, round(count(rel.unit) filter (r.rank <= k) / k, 6) as precision from nr join rk r using (query_id) left join rel on rel.query_id = r.query_id and rel.unit = r.unit, ks group by query_id, k")
def topk_sensitivity(spark, d):
    r, rel = _judged(spark, d)
    return E.sensitivity(r, rel).select("query_id", F.col("k").cast("long").alias("k"), six("recall"), six("precision"))


def _sectioned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = outlined(spark, d)
    return docs, E.sections(O.build_tree(O.find_headings(docs), docs)), C.fixed(docs)


_SECT = f"{S.OUTLINE}, {S.chunks('o')}"


@query(f"with {_SECT} select l.doc_id, count(*) as n_sections, count(*) filter (exists (select 1 from c where c.doc_id = l.doc_id and c.char_start <= l.char_start and c.char_end >= l.char_end)) as n_intact from leaf l group by l.doc_id")
def section_integrity(spark, d):
    _, leaves, chunks = _sectioned(spark, d)
    return E.integrity(leaves, chunks)


@query(f"with {_SECT} select c.doc_id, cast(chunk_idx as bigint) as chunk_idx, count(*) as n_sections from c join leaf l on l.doc_id = c.doc_id and least(l.char_end, c.char_end) - greatest(l.char_start, c.char_start) >= 25 group by c.doc_id, chunk_idx having count(*) >= 2")
def mixed_chunks(spark, d):
    _, leaves, chunks = _sectioned(spark, d)
    return E.mixed(leaves, chunks).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "n_sections")


@query(f"""with {S.chunks()}, x as (select doc_id, chunk_idx, char_start, char_end, n, substring(text, char_start, 2) as edge, substring(text, char_start + 1, char_end - char_start) as own from c join documents using (doc_id))
select doc_id, cast(chunk_idx as bigint) as chunk_idx, char_start > 0 and regexp_matches(edge, '^[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}]$') as mid_word, char_end < n and not ends_with(own, chr(10)) and not regexp_matches(rtrim(own, ' ' || chr(10)), '[.!?:;]$') as ragged from x""")
def cut_quality(spark, d):
    docs = read(spark, d, "documents")
    return E.damage(C.fixed(docs), docs).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "mid_word", "ragged")


@query(f"with {S.chunks()} select doc_id, count(*) as n_chunks, cast(min(char_end - char_start) as bigint) as min_size, cast(max(char_end - char_start) as bigint) as max_size, cast(list_sort(list(char_end - char_start))[cast(floor(count(*) / 2) as bigint) + 1] as bigint) as median_size, cast(floor(avg(char_end - char_start)) as bigint) as mean_size from c group by doc_id")
def chunk_sizes(spark, d):
    return _long(E.size_stats(C.fixed(read(spark, d, "documents"))), "doc_id", "n_chunks", "min_size", "max_size", "median_size", "mean_size")


@query(f"with {S.chunks()} select doc_id, cast(0 as bigint) as uncovered, cast(sum(char_end - char_start) - any_value(n) as bigint) as duplicated, round(sum(char_end - char_start) / any_value(n), 6) as redundancy from c group by doc_id")
def chunk_coverage(spark, d):
    docs = read(spark, d, "documents")
    return E.coverage(C.fixed(docs), docs).select("doc_id", F.col("uncovered").cast("long").alias("uncovered"), F.col("duplicated").cast("long").alias("duplicated"), six("redundancy"))


@query(f"with {_SECT} select l.doc_id, l.node_id, l.title as query, cast(c.chunk_idx as bigint) as chunk_idx from leaf l join c on c.doc_id = l.doc_id where length(l.title) >= 3 and least(l.char_end, c.char_end) - greatest(l.char_start, c.char_start) >= 40 and least(l.char_end, c.char_end) - greatest(l.char_start, c.char_start) >= 0.3 * (c.char_end - c.char_start)")
def golden_set(spark, d):
    _, leaves, chunks = _sectioned(spark, d)
    cases, relevant = E.golden_set(leaves, chunks)
    return cases.join(relevant, ["doc_id", "node_id"]).select("doc_id", "node_id", "query", F.col("chunk_idx").cast("long").alias("chunk_idx"))


@query()
def strategy_comparison(spark, d):
    """Size, coverage and damage of the three chunkers over all documents."""
    docs = outlined(spark, d)
    bounds = O.find_headings(docs)
    out = None
    for name in C.STRATEGIES:
        c = E.damage(C.chunk(docs, name, 800, 100, bounds), docs)
        row = c.agg(F.lit(name).alias("strategy"), F.count("*").alias("n_chunks"), F.sum(F.col("mid_word").cast("long")).alias("mid_word"), F.sum(F.col("ragged").cast("long")).alias("ragged"), F.max(F.col("char_end") - F.col("char_start")).alias("max_size"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- assembly and answers


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """An assistant's turn as an answer to the turn before it."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = read(spark, d, "conversations").withColumn("before", F.lag("text").over(by)).withColumn("no", F.row_number().over(by))
    return t.where("role = 'assistant' and before is not null")


_TURNS = "t0 as (select *, lag(text) over w as before, row_number() over w as no from conversations window w as (partition by conv_id order by turn, role, text)), t as (select * from t0 where role = 'assistant' and before is not null)"


@query(f"with {_TURNS}, a as (select conv_id, no, list_distinct({S.content('text')}) as a, list_distinct({S.content('before')}) as c from t) select conv_id, no, round(case when len(a) > 0 then 1 - len(list_filter(a, lambda x: not list_contains(c, x))) / len(a) else 0.0 end, 6) as coverage, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(c, x))), ',') as unsupported from a")
def grounding(spark, d):
    marked = F.concat("text", F.lit(" [c0001, p1]"))
    g = _turns(spark, d).select("conv_id", F.col("no").cast("long").alias("no"), A.grounding(marked, "before").alias("g"))
    return g.select("conv_id", "no", F.round("g.coverage", 6).alias("coverage"), F.array_join("g.unsupported", ",").alias("unsupported"))


@query(f"with {_TURNS} select conv_id, no, 'c' || conv_id || ',c09' as cited, 'c09' as unknown, false as valid from t")
def citation_check(spark, d):
    """An answer that cites the turn that was sent and one that wasn't: no number is written with a leading 0."""
    own = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    answer = F.concat("text", F.lit(" ["), own, F.lit(", p3] and [c09]"))
    c = _turns(spark, d).select("conv_id", F.col("no").cast("long").alias("no"), A.check_citations(answer, F.array(own)).alias("c"))
    return c.select("conv_id", "no", F.array_join("c.cited", ",").alias("cited"), F.array_join("c.unknown", ",").alias("unknown"), "c.valid")


@query("""with recursive p as (select conv_id, cast(row_number() over (partition by conv_id order by turn, role, text) - 1 as bigint) as place, cast(floor(length(text) / 4) + 1 as bigint) as cost from conversations),
r as (select conv_id, place, cost, cost <= 300 as admitted, case when cost <= 300 then cost else 0 end as used from p where place = 0
  union all select p.conv_id, p.place, p.cost, r.used + p.cost <= 300, case when r.used + p.cost <= 300 then r.used + p.cost else r.used end from p join r on p.conv_id = r.conv_id and p.place = r.place + 1)
select conv_id, place, cost, admitted from r""")
def greedy_budget(spark, d):
    """Turns of a conversation, first to last, into 300 tokens."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    items = read(spark, d, "conversations").select("conv_id", (F.row_number().over(by) - 1).cast("long").alias("place"), T.estimate_tokens("text").alias("cost"))
    return A.admit(items, F.lit(300).cast("long"), ["conv_id"]).select("conv_id", "place", "cost", "admitted")


@query("""with p as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as place from conversations), n as (select *, count(*) over (partition by conv_id) as n from p)
select conv_id, place, n - 1 - place as best_last, row_number() over (partition by conv_id order by place % 2, case when place % 2 = 0 then place else -place end) - 1 as edges from n""")
def chunk_orderings(spark, d):
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    p = read(spark, d, "conversations").select("conv_id", (F.row_number().over(by) - 1).cast("long").alias("place"))
    at = lambda o: (F.row_number().over(Window.partitionBy("conv_id").orderBy(A.order_key(F.col("place"), F.col("place"), o))) - 1).cast("long").alias(o)
    return p.select("conv_id", "place", at("best_last"), at("edges"))


@query(f"select conv_id, turn, role, cast(len(s) as bigint) as n_sentences, array_to_string(s, '|') as joined from (select conv_id, turn, role, {S.sentences('text')} as s from conversations)")
def sentences(spark, d):
    s = read(spark, d, "conversations").select("conv_id", "turn", "role", T.sentences("text").alias("s"))
    return s.select("conv_id", "turn", "role", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", "|").alias("joined"))


@query(f"select doc_id, cast(len(w) as bigint) as n_words, cast(len(list_distinct(w)) as bigint) as n_distinct from (select doc_id, {S.content('text')} as w from documents)")
def content_words(spark, d):
    w = read(spark, d, "documents").select("doc_id", T.content_words("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(f"""with s as (select doc_id, {S.sentences('text')} as s from documents),
o as (select doc_id, s, case when len(string_split(s[1], ' ')) > 45 then array_to_string(string_split(s[1], ' ')[1:45], ' ') || '...' else s[1] end as opening from s),
w as (select doc_id, unnest({S.content("array_to_string(s[2:], ' ')")}) as x, generate_subscripts({S.content("array_to_string(s[2:], ' ')")}, 1) as i, {S.content('opening')} as seen from o),
f as (select doc_id, x, min(i) as i from w where not list_contains(seen, x) group by all),
k as (select *, row_number() over (partition by doc_id order by i) as r from f),
t as (select doc_id, string_agg(x, ', ' order by i) as tail from k where r <= 8 group by doc_id)
select o.doc_id, case when len(s) = 0 then '(empty section)' when tail is null then opening else opening || ' Also covers: ' || tail || '.' end as summary from o left join t using (doc_id)""")
def extractive_summary(spark, d):
    return read(spark, d, "documents").select("doc_id", T.summarise("text", F.lit("")).alias("summary"))


@query(f"""with {_TURNS}, s as (select conv_id, no, before, unnest({S.sentences('text')}) as s, generate_subscripts({S.sentences('text')}, 1) as pos from t),
c as (select *, {S.overlap('before', 's')} as score from s), r as (select *, row_number() over (partition by conv_id, no order by score desc, pos) as r from c),
k as (select conv_id, no, string_agg(s, ' ' order by pos) filter (score > 0 and r <= 3) as answer from r group by all)
select t.conv_id, t.no, case when k.conv_id is null then '{A.NO_CONTEXT}' else coalesce(answer, '{A.NO_MATCH}') end as answer from t left join k on k.conv_id = t.conv_id and k.no = t.no""")
def extractive_answer(spark, d):
    """The turn before asks, the assistant's turn is the context."""
    t = _turns(spark, d).select(F.struct("conv_id", F.col("no").cast("long").alias("no")).alias("query_id"), F.col("before").alias("question"), F.col("text").alias("context"))
    return A.extract_answers(t).select("query_id.conv_id", "query_id.no", "answer")


@query(f"""with {_TURNS}, o as (select t.conv_id, t.no, t.before, c.place, {S.overlap('t.before', 'c.text')} as score from t join (select conv_id, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as place from conversations) c using (conv_id)),
r as (select *, row_number() over (partition by conv_id, no order by round(score, 9) desc, place) as r, max(score) over (partition by conv_id, no) as best from o)
select conv_id, no, cast(place as bigint) as place, r as pick from r where (score > 0 and r <= 2) or (best = 0 and r = 1)""")
def choose_options(spark, d):
    """Which two turns of its conversation a question meets best."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    options = read(spark, d, "conversations").select("conv_id", F.col("text").alias("option"), (F.row_number().over(by) - 1).cast("long").alias("place"))
    q = _turns(spark, d).select("conv_id", F.col("no").cast("long").alias("no"), "before")
    s = q.join(options, "conv_id").withColumn("score", F.round(T.overlap_score("before", "option"), 9))
    w = Window.partitionBy("conv_id", "no")
    s = s.withColumn("pick", F.row_number().over(w.orderBy(F.desc("score"), "place")).cast("long")).withColumn("best", F.max("score").over(w))
    return s.where(((F.col("score") > 0) & (F.col("pick") <= 2)) | ((F.col("best") == 0) & (F.col("pick") == 1))).select("conv_id", "no", "place", "pick")


@query("select doc_id, case when doc_id % 4 = 0 then '0' when doc_id % 4 = 1 then '1' else (doc_id % 4) || ',1' end as choices from documents")
def valid_choices(spark, d):
    """Ids out of range, negative, null and repeated are no choice."""
    i = (F.col("doc_id") % 4).cast("int")
    raw = F.when(i == 0, F.array(F.lit(9), F.lit(-1), F.lit(None).cast("int"))).otherwise(F.array(i, i, F.lit(1), F.lit(7)))
    return read(spark, d, "documents").select("doc_id", F.array_join(TR.valid_choices(raw, 5, 2), ",").alias("choices"))


# ---- trees


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = outlined(spark, d)
    return docs, TR.summarise_tree(O.build_tree(O.find_headings(docs), docs), docs)


@query()
def tree_summaries(spark, d):
    return _tree(spark, d)[1].select("doc_id", "node_id", "parent_id", "title", "summary")


@query()
def summary_quality(spark, d):
    return TR.summary_quality(_tree(spark, d)[1])


def _asked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("query_id"), "doc_id", F.element_at(F.split("text", "\n"), -1).alias("question"))


@query()
def beam_search(spark, d):
    """Each document is asked its own last line."""
    docs, nodes = _tree(spark, d)
    return TR.beam_search(nodes, _asked(docs))[0]


@query()
def beam_pruned(spark, d):
    docs, nodes = _tree(spark, d)
    return TR.pruned(TR.beam_search(nodes, _asked(docs))[1])


@query()
def tree_context(spark, d):
    docs, nodes = _tree(spark, d)
    found, _ = TR.beam_search(nodes, _asked(docs))
    text = O.node_text(nodes, docs).withColumn("label", F.lit("p1"))
    return TR.section_context(found, text, _asked(docs))
