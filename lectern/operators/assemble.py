"""Context assembly under a budget, and checks of an answer against what was sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
ROLE_PROMPT = "You are a document assistant. Below is context retrieved from one document, followed by a question about it."
SYSTEM_PROMPT = """Answer the question using ONLY the context above.

Rules:
- Cite the source marker for every claim, like [c0003, p8-10].
- If the context does not contain the answer, say so plainly. Do not guess.
- If two sources disagree, say that rather than picking one.
- Do not add information from outside the context, however obvious it seems."""
NO_CONTEXT = "No context was retrieved, so there is nothing to answer from."
NO_MATCH = "Nothing in the retrieved context shares wording with the question. A real model would say it cannot answer; this stand-in can only report the absence."
OVERHEAD, PER_CHUNK, PER_SECTION = 40, 4, 12
ORDERINGS = ["best_first", "best_last", "document", "edges"]


def order_key(place: Column, char_start: Column, ordering: str) -> Column:
    """What to sort by; place counts from 0, best first."""
    if ordering == "best_first":
        return F.struct(place.cast("long"), F.lit(0).cast("long"))
    if ordering == "best_last":
        return F.struct((-place).cast("long"), F.lit(0).cast("long"))
    if ordering == "document":
        return F.struct(char_start.cast("long"), place.cast("long"))
    if ordering == "edges":
        return F.struct((place % 2).cast("long"), F.when(place % 2 == 0, place).otherwise(-place).cast("long"))
    raise ValueError(f"ordering must be one of {ORDERINGS}")


def admit(items: DataFrame, remaining: Column, keys: list[str]) -> DataFrame:
    """items(keys, place, cost) and the budget that remains -> admitted: in the order of place, whatever still fits; a smaller one may after a larger one didn't."""
    listed = items.groupBy(*keys).agg(F.max(remaining).alias("_left"), F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("cost").cast("long").alias("cost")))).alias("_list"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("got"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["cost"] <= F.col("_left")
        return F.when(fits, F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["got"], F.array(x["place"])).alias("got"))).otherwise(a)

    folded = listed.withColumn("_fold", F.aggregate("_list", start, step)).select(*keys, F.col("_fold.used").alias("used"), F.col("_fold.got").alias("got"))
    return items.join(folded, keys).withColumn("admitted", F.array_contains("got", F.col("place").cast("int"))).drop("got")


def overhead(question: Column | str) -> Column:
    return T.estimate_tokens(F.lit(ROLE_PROMPT)) + T.estimate_tokens(F.lit(SYSTEM_PROMPT)) + T.estimate_tokens(question) + OVERHEAD


def chunk_cost(chunk_id: Column, start_page: Column, text: Column) -> Column:
    """Tokens of the marker with the first page and of the raw text."""
    marker = F.concat(F.lit("["), chunk_id, F.lit(", p"), F.coalesce(start_page.cast("string"), F.lit("None")), F.lit("]"))
    return T.estimate_tokens(F.concat(marker, text)) + PER_CHUNK


def block(chunk_id: Column, label: Column, text: Column) -> Column:
    return F.concat(F.lit("["), chunk_id, F.lit(", "), label, F.lit("]\n"), T.squeeze(text))


def assemble(shortlist: DataFrame, budget: int = 2000, ordering: str = "best_first") -> DataFrame:
    """shortlist(query_id, question, place, chunk_id, char_start, start_page, label, text) -> query_id, question, context, prompt, sent, context_tokens."""
    items = shortlist.withColumn("cost", chunk_cost(F.col("chunk_id"), F.col("start_page"), F.col("text")))
    got = admit(items, F.lit(budget) - overhead("question"), ["query_id"])
    key = order_key(F.col("place"), F.col("char_start"), ordering)
    sent = F.collect_list(F.when(F.col("admitted"), F.struct(key.alias("k"), F.col("chunk_id").alias("id"), block(F.col("chunk_id"), F.col("label"), F.col("text")).alias("b"))))
    out = got.groupBy("query_id", "question").agg(F.array_sort(sent).alias("s"), F.max("used").alias("context_tokens"))
    context = F.array_join(F.transform("s", lambda x: x["b"]), "\n\n")
    prompt = F.concat(F.lit(ROLE_PROMPT + "\n\nContext:\n"), context, F.lit("\n\n" + SYSTEM_PROMPT + "\n\nQuestion: "), F.col("question"))
    return out.select("query_id", "question", context.alias("context"), prompt.alias("prompt"), F.transform("s", lambda x: x["id"]).alias("sent"), "context_tokens")


def grounding(answer: Column | str, context: Column | str) -> Column:
    """struct<coverage, unsupported>: how many of the answer's content words the context has; markers don't count."""
    bare = lambda c: F.regexp_replace(T.col(c), r"\[[^\]]*\]", " ")
    a, c = F.array_distinct(T.content_words(bare(answer))), F.array_distinct(T.content_words(bare(context)))
    lost = F.array_sort(F.array_except(a, c))
    return F.struct(F.when(F.size(a) > 0, 1 - F.size(lost) / F.size(a)).otherwise(F.lit(0.0)).alias("coverage"), lost.alias("unsupported"))


def citations(answer: Column | str) -> Column:
    return F.regexp_extract_all(T.col(answer), F.lit(r"\[([a-z]?\d+[^\]]*)\]"), F.lit(1))


def check_citations(answer: Column | str, sent: Column | str) -> Column:
    """struct<cited, unknown, valid>: only the first id of a marker counts; none cited is valid."""
    first = F.transform(citations(answer), lambda x: F.trim(F.split(x, ",")[0]))
    unknown = F.filter(first, lambda x: ~F.array_contains(T.col(sent), x))
    return F.struct(first.alias("cited"), unknown.alias("unknown"), (F.size(unknown) == 0).alias("valid"))


def extract_answers(contexts: DataFrame, most: int = 3) -> DataFrame:
    """contexts(query_id, question, context) -> query_id, answer: the sentences that share most words with the question, in their order."""
    s = T.sentences("context")
    rows = contexts.select("query_id", "question", F.size(s).alias("n"), F.posexplode_outer(s).alias("pos", "s"))
    scored = rows.withColumn("score", T.overlap_score("question", F.coalesce("s", F.lit(""))))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    kept = F.when((F.col("score") > 0) & (F.col("r") <= most), F.struct("pos", "s"))
    out = scored.withColumn("r", r).groupBy("query_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(kept)).alias("k"))
    text = F.when(F.coalesce(F.col("n"), F.lit(0)) <= 0, F.lit(NO_CONTEXT)).when(F.size("k") == 0, F.lit(NO_MATCH)).otherwise(F.array_join(F.transform("k", lambda x: x["s"]), " "))
    return out.select("query_id", text.alias("answer"))
