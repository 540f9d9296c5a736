"""Preference formatting: two conversations as one prompt and two masked completions.

The longest common prefix of turns (equal role and text) of a chosen and a rejected conversation
is rendered once as the prompt; what follows in each is a completion with a mask: the ranges of its
characters that are an assistant's words (and the end mark after them), which a loss is taken on.

Turns stand in the order of turn, then role and text; exact repeats of a row are one turn. A null
text is empty, a null role is "user", a null turn comes first; rows without conv_id are left out.
Marks inside a text are broken up, so that no text can end its turn. A pair of equal conversations
has empty completions; a conversation without a partner gives no pair. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _rendered(turn: str) -> F.Column:
    return F.concat(F.lit(OPEN), F.col(f"{turn}.role"), F.lit("\n"), F.col(f"{turn}.text"), F.lit(CLOSE))


def preferences(turns: DataFrame, pairs: F.Column, rejected: F.Column) -> DataFrame:
    """turns(conv_id, turn, role, text); `pairs` names a pair and `rejected` its side, as columns over conv_id.

    -> pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask;
    masks as "start:end" ranges joined by commas.
    """
    t = (
        turns.where("conv_id is not null")
        .select(
            pairs.cast("long").alias("pair_id"),
            rejected.alias("rejected"),
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            F.coalesce("role", F.lit("user")).alias("role"),
            F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        )
        .repartition("pair_id")  # all that follows keeps this partitioning: one shuffle in all
        .groupBy("pair_id", "rejected", "conv_id", "turn", "role", "text")
        .agg(F.lit(1).alias("one"))
    )
    t = t.withColumn("pos", F.row_number().over(Window.partitionBy("pair_id", "rejected").orderBy("turn", "role", "text")))
    side = lambda r: F.max(F.when(F.col("rejected") == r, F.struct("role", "text")))
    ids = lambda r: F.max(F.when(F.col("rejected") == r, F.col("conv_id")))
    rows = t.groupBy("pair_id", "pos").agg(side(False).alias("c"), side(True).alias("r"), ids(False).alias("ci"), ids(True).alias("ri"))
    upto = Window.partitionBy("pair_id").orderBy("pos")
    rows = rows.withColumn("common", F.min(F.coalesce(F.col("c") == F.col("r"), F.lit(False)).cast("int")).over(upto) == 1)
    for x in "cr":
        rows = rows.withColumn(f"{x}s", F.when(~F.col("common"), _rendered(x)))
        end = F.sum(F.coalesce(F.length(f"{x}s"), F.lit(0))).over(upto)
        head = F.length(F.lit(OPEN)) + F.length(f"{x}.role") + 1
        begin = end - F.length(f"{x}s") + head
        rows = rows.withColumn(f"{x}m", F.when((F.col(f"{x}.role") == "assistant") & F.col(f"{x}s").isNotNull(), F.concat_ws(":", begin.cast("string"), (end - 1).cast("string"))))
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("pos", c.alias("x"))))), lambda s: s["x"]), by)
    return (
        rows.groupBy("pair_id")
        .agg(
            F.max("ci").alias("chosen_id"),
            F.max("ri").alias("rejected_id"),
            F.sum(F.col("common").cast("long")).alias("n_common"),
            joined(F.when(F.col("common"), _rendered("c")), "").alias("prompt"),
            joined(F.col("cs"), "").alias("chosen"),
            joined(F.col("rs"), "").alias("rejected"),
            joined(F.col("cm"), ",").alias("chosen_mask"),
            joined(F.col("rm"), ",").alias("rejected_mask"),
        )
        .where("chosen_id is not null and rejected_id is not null")
    )


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected."""
    return preferences(table(spark, sf_dir, "conversations"), F.floor(F.col("conv_id") / 2), F.pmod(F.col("conv_id"), F.lit(2)) == 1)


SQL = f"""
with t as (select distinct cast(floor(conv_id / 2) as bigint) as pair_id, conv_id % 2 = 1 as rejected, conv_id, turn, coalesce(role, 'user') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations where conv_id is not null),
p as (select *, row_number() over (partition by pair_id, rejected order by turn nulls first, role, text) as pos from t),
s as (select pair_id, pos, max(conv_id) filter (not rejected) as ci, max(conv_id) filter (rejected) as ri,
  max(role) filter (not rejected) as cr, max(text) filter (not rejected) as ct, max(role) filter (rejected) as rr, max(text) filter (rejected) as rt from p group by pair_id, pos),
e as (select *, min(case when cr = rr and ct = rt then 1 else 0 end) over (partition by pair_id order by pos) = 1 as common from s),
d as (select *, case when cr is not null then '{OPEN}' || cr || chr(10) || ct || '{CLOSE.strip()}' || chr(10) end as c, case when rr is not null then '{OPEN}' || rr || chr(10) || rt || '{CLOSE.strip()}' || chr(10) end as r from e),
o as (select *, sum(case when common then 0 else coalesce(length(c), 0) end) over w as cend, sum(case when common then 0 else coalesce(length(r), 0) end) over w as rend from d window w as (partition by pair_id order by pos))
select pair_id, max(ci) as chosen_id, max(ri) as rejected_id, cast(sum(common::int) as bigint) as n_common,
  coalesce(string_agg(c, '' order by pos) filter (common), '') as prompt,
  coalesce(string_agg(c, '' order by pos) filter (not common), '') as chosen,
  coalesce(string_agg(r, '' order by pos) filter (not common), '') as rejected,
  coalesce(string_agg(cast(cend - length(c) + {len(OPEN) + 1} + length(cr) as bigint) || ':' || cast(cend - 1 as bigint), ',' order by pos) filter (not common and cr = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(cast(rend - length(r) + {len(OPEN) + 1} + length(rr) as bigint) || ':' || cast(rend - 1 as bigint), ',' order by pos) filter (not common and rr = 'assistant'), '') as rejected_mask
from o group by pair_id having max(ci) is not null and max(ri) is not null
"""
