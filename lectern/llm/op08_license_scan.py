"""License scan by diagonal voting, in DataFrame operations only.

Every rolling 3-word gram of every text is hashed and joined to the positions of that gram in a
fixed set of templates (a table of some hundred rows, broadcast). A hit votes for the diagonal
text position - template position; hits on one diagonal are a bit mask over template positions, so
votes add up in any order and repeat harmlessly. Neighbouring diagonals (words inserted or left
out) are merged, and a span counts when its mask covers enough of the template. A phrase stands
whole where one diagonal covers all of its grams.

A null or empty text has no words and no label. Rows that agree in doc_id and text are counted and
given back as often as they came. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 3
SLACK = 3
COVER = 0.6
#: Phrases that label a text wherever they stand whole.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Notices that label a text when most of their words stand in order; at most 63 grams each.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "all rights reserved"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _templates() -> list[tuple[int, str, bool, int, int, str, str, str]]:
    """(template, label, whether a base phrase, grams, position, word, word, word)."""
    out = []
    for tid, (label, phrase) in enumerate(BASE + NOTICES):
        w = phrase.split()
        out += [(tid, label, tid < len(BASE), len(w) - K + 1, i, *w[i : i + K]) for i in range(len(w) - K + 1)]
    return out


def _groups(docs: DataFrame) -> DataFrame:
    """Merged diagonals (doc_id, h, tid, label, base, grams, lo, hi, mask, whole), and a row without tid for each (doc_id, text) with `copies` and `n_words`."""
    spark = docs.sparkSession
    templates = spark.createDataFrame(_templates(), "tid int, label string, base boolean, grams int, tpos int, t0 string, t1 string, t2 string").withColumn("gram", F.xxhash64("t0", "t1", "t2"))
    clean = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), _BREAK, " "))
    end = F.lit("\0")  # no word holds it: one row for each text, whatever its words
    words = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.split(F.concat_ws(" ", F.when(clean != "", clean), end), " ").alias("words"))
    w = lambda i: F.get("words", F.col("pos") + i)
    grams = words.select("doc_id", "h", "words", F.posexplode("words").alias("pos", "w0")).select("doc_id", "h", "pos", "w0", w(1).alias("w1"), w(2).alias("w2")).withColumn("gram", F.xxhash64("w0", "w1", "w2"))
    same = (grams["gram"] == templates["gram"]) & (grams["w0"] == templates["t0"]) & (grams["w1"] == templates["t1"]) & (grams["w2"] == templates["t2"])
    # bounded: the table is made of the constants above
    hits = grams.join(F.broadcast(templates), same, "left").where(F.col("tid").isNotNull() | (F.col("w0") == end))
    votes = (
        hits.select("doc_id", "h", "tid", "label", "base", "grams", F.when(F.col("tid").isNull(), F.col("pos")).alias("n_words"), (F.col("pos") - F.col("tpos")).alias("diag"), "tpos")
        .repartition(F.col("doc_id"), F.col("h"))
        .groupBy("doc_id", "h", "tid", "label", "base", "grams", "diag")
        .agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"), F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask"))
    )
    by = Window.partitionBy("doc_id", "h", "tid").orderBy("diag")
    new = F.when(F.col("diag") - F.lag("diag").over(by) <= SLACK, 0).otherwise(1)
    # a base phrase is judged on one diagonal alone
    merged = votes.withColumn("new", F.when(F.col("base"), 1).otherwise(new)).withColumn("part", F.sum("new").over(by))
    return merged.groupBy("doc_id", "h", "tid", "label", "base", "grams", "part").agg(
        F.min("diag").alias("lo"), F.max("diag").alias("hi"), F.bit_or("mask").alias("mask"), F.max("n_words").alias("n_words"), F.max("copies").alias("copies")
    ).withColumn("cover", F.expr("bit_count(mask) / grams"))


def license_spans(docs: DataFrame) -> DataFrame:
    """doc_id, label, first_word, end_word, coverage of each span that counts; of rows that agree in doc_id and text, once."""
    g = _groups(docs).where(F.col("tid").isNotNull() & (F.col("cover") >= F.when(F.col("base"), 1.0).otherwise(COVER)))
    return g.select("doc_id", "label", F.greatest(F.lit(0), "lo").cast("long").alias("first_word"), (F.col("hi") + F.col("grams") + K - 1).cast("long").alias("end_word"), F.col("cover").alias("coverage"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: places and labels of base phrases, all labels, and the best coverage as score."""
    whole = F.col("base") & (F.col("cover") >= 1)
    found = whole | (~F.col("base") & (F.col("cover") >= COVER))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    g = _groups(docs).groupBy("doc_id", "h").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("lo"))).cast("long").alias("last_word"),
        joined(whole).alias("base_labels"),
        joined(found).alias("labels"),
        F.round(F.coalesce(F.max(F.when(whole | ~F.col("base"), F.col("cover"))), F.lit(0.0)), 6).alias("score"),
        F.max(F.when(F.col("tid").isNull(), F.col("copies"))).alias("copies"),
    )
    return g.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("h", "copies", "copy")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


SQL = f"""
with templates(tid, label, base, grams, tpos, t0, t1, t2) as (values {", ".join(str(r).replace("True", "true").replace("False", "false") for r in _templates())}),
docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
pos as (select r, words, unnest(range(len(words))) as p from docs),
hits as (select pos.r, t.*, p - tpos as diag from pos join templates t on words[p + 1] = t0 and words[p + 2] = t1 and words[p + 3] = t2),
votes as (select r, tid, label, base, grams, diag, list(distinct tpos) as seen from hits group by all),
marks as (select *, case when base or lag(diag) over w is null or diag - lag(diag) over w > {SLACK} then 1 else 0 end as fresh from votes window w as (partition by r, tid order by diag)),
parts as (select *, sum(fresh) over (partition by r, tid order by diag) as part from marks),
spans as (select r, tid, label, base, min(diag) as lo, len(list_distinct(flatten(list(seen)))) / grams as cover from parts group by r, tid, label, base, grams, part),
best as (select r, count(*) filter (base and cover >= 1) as n_base, min(lo) filter (base and cover >= 1) as first_word, max(lo) filter (base and cover >= 1) as last_word,
  string_agg(distinct label, ',' order by label) filter (base and cover >= 1) as base_labels,
  string_agg(distinct label, ',' order by label) filter (case when base then cover >= 1 else cover >= {COVER} end) as labels,
  max(cover) filter (not base or cover >= 1) as score from spans group by r)
select d.doc_id, cast(len(d.words) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(coalesce(score, 0)::double, 6) as score
from docs d left join best b using (r)
"""
