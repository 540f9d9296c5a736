"""N-gram Jaccard join: an exact self-join under the Jaccard metric d = 1 - J, by pivots and windows.

Cells. Two sets with J >= 0.75 share one of their first few members when members are ordered
rarest first (shingle_index). Each such shingle opens a cell; a document is replicated to all the
cells whose shingle is in its window of the order. Distances from any document pivot to unrelated
texts are all 1, so this first level uses shingles as pivots; document pivots work inside the cells.

Pivots in a cell. Each round a cell takes pivots: its most central member and, if it is large, three
that are chosen by hash, which meet a cluster with a chance that follows its size. Their distances to
every member are computed exactly. With t = 0.25, what lies within t of a pivot p is linked to p: one
class, no pair inside needs to be looked at. Beyond it a member y can only be linked to a ball member
x when d(y,p) - d(x,p) <= t (triangle inequality), so only the boundary layers meet; y meets a few
deputies of the ball first, as one link into it is enough. Layers of more than a few rows a member
don't meet pair by pair: with S the shingles by which a member differs from the ball (from what most of it
holds), |x & y| = (|x| + |y| - |S(x)| - |S(y)|) / 2 + |S(x) & S(y)|. So either no common difference is needed
and y is linked to the one nearest to the ball, or x and y share one of the first of their differences, rarest
first. Members outside all balls go to the next round with new pivots. After `rounds` rounds what is left of a cell is joined
directly, under the same bounds; one of more than LARGE members is first opened anew, by the shingles
that not all of them have.

Results are exact: every pair of sets that shares a cell is verified, or is within a ball (its
two members then have the same class), or is ruled out by the triangle inequality, by sizes, or by
the count of shingles that it shares with the
pivot and with anyone. Copies are one set and never meet each other.

Null or empty texts have no shingles and are linked with nothing; rows without doc_id are left
out; repeated rows are copies; further columns of the input are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, contained, drop, table, written
from .shingle_index import index

ROUNDS, SMALL, LARGE, WIDE = 3, 8, 256, 16


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with the intersection `both` and sizes na, nb; the shared members decide, as lone ones meet nothing."""
    a = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("both"))


def _far(both: str = "both") -> F.Column:
    """The Jaccard distance in double precision, only ever compared with a margin."""
    return 1.0 - F.col(both) / (F.col("na") + F.col("nb") - F.col(both))


def _linked(num: int) -> F.Column:
    return 100 * F.col("both").cast("long") >= num * (F.col("na").cast("long") + F.col("nb") - F.col("both"))


def _most(n: str, lone: str, both: str, other_n: str, other_lone: str, other_both: str) -> F.Column:
    """The largest possible intersection of two members, given what each shares with one pivot and how many members nobody shares."""
    rest, other = F.col(n) - F.col(lone) - F.col(both), F.col(other_n) - F.col(other_lone) - F.col(other_both)
    return (F.least(F.col(both), F.col(other_both)) + F.least(rest, other)).cast("long")


def _may(num: int) -> F.Column:
    """False where sizes, lone members and shares with the pivot already forbid a link of a and b."""
    most = _most("na", "la", "ba", "nb", "lb", "bb")
    return 100 * most >= num * (F.col("na").cast("long") + F.col("nb") - most)


def _hope(num: int) -> F.Column:
    """False where a member outside the ball can be linked to none inside: by what it shares at all, and the least size inside."""
    most = (F.col("n") - F.col("lone")).cast("long")
    most = F.least(most, F.col("both") + F.least(F.col("n") - F.col("lone") - F.col("both"), F.col("slack")))
    return 100 * most >= num * (F.greatest(F.col("smallest").cast("long"), most) + F.col("n") - most)


def _cells(seats: DataFrame, facts: DataFrame) -> DataFrame:
    """Members of each cell with two or more, from seats(cell, cid); cells with the same members are one."""
    who = seats.groupBy("cell").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(7))).alias("y")).where("c > 1")
    named = seats.join(who.select("cell", F.xxhash64("c", "x", "y").alias("as")), "cell").select(F.col("as").alias("cell"), "cid").distinct()
    return written(named.join(facts, "cid").select("cell", "cid", "n", "lone", "central", F.lit(0.0).alias("f"), F.lit(0).alias("w")), "cells")


def _opened(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """seats(cell, cid) of the child cells of cells(cell, cid): where the members have c shingles in common, two that are
    linked share more than c of their first prefix + c, so one at least that not all members have; each of these is a child."""
    held = written(cells.select("cell", "cid").join(sets.select("cid", "prefix", "tokens"), "cid"), "large")
    size = held.groupBy("cell").agg(F.count("*").alias("m"))
    each = held.select("cell", F.explode("tokens").alias("token")).groupBy("cell", "token").agg(F.count("*").alias("c")).join(size, "cell")
    common = size.select("cell").join(each.where("c = m").groupBy("cell").agg(F.collect_list("token").alias("common")), "cell", "left")
    common = common.select("cell", F.coalesce("common", F.array().cast("array<long>")).alias("common"))
    first = F.slice("tokens", F.lit(1), F.col("prefix") + F.size("common"))
    return held.join(common, "cell").select(F.col("cell").alias("of"), "cid", F.explode(F.array_except(first, "common")).alias("token")).select(F.xxhash64("of", "token").alias("cell"), "cid")


def _direct(cells: DataFrame, num: int) -> DataFrame:
    """Pairs within cells that distances to one pivot, sizes and shares don't rule out."""
    x = cells.select("cell", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("lone").alias("la"), F.col("f").alias("fa"), F.col("w").alias("ba"))
    y = cells.select("cell", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("lone").alias("lb"), F.col("f").alias("fb"), F.col("w").alias("bb"))
    return x.join(y, "cell").where((F.col("a") < F.col("b")) & (F.abs(F.col("fa") - F.col("fb")) <= 1 - num / 100 + 1e-9) & _may(num)).select("a", "b")


def _window(num: int) -> F.Column:
    return (F.col("fa") - F.col("fb") <= 1 - num / 100 + 1e-9) & _may(num)


def _layers(out: DataFrame, inn: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """Pairs (a, b) of members outside and inside a ball that may be linked, but for one pair of those that surely are."""
    at = ["p", "seed"]
    size = written(out.groupBy(at).agg(F.count("*").alias("o")).join(inn.groupBy(at).agg(F.count("*").alias("i")), at), "balls")
    wide = size.where(f"o * i > {WIDE} * (o + i)")
    few = out.join(size.where(f"o * i <= {WIDE} * (o + i)").select(at), at).join(inn, at).where(_window(num)).select("a", "b")
    if wide.isEmpty():
        return few
    rows = out.select(*at, F.col("a").alias("c"), F.lit(True).alias("outer"), F.col("na").alias("n"))
    rows = rows.unionByName(inn.select(*at, F.col("b").alias("c"), F.lit(False).alias("outer"), F.col("nb").alias("n"))).join(wide.select(*at, "i"), at)
    rows = rows.join(sets.select(F.col("cid").alias("c"), "tokens"), "c").join(sets.select(F.col("cid").alias("p"), F.col("tokens").alias("of")), "p")
    apart = F.concat(F.array_except("tokens", "of"), F.array_except("of", "tokens")).alias("apart")
    rows = written(rows.select(*at, "i", "c", "outer", "n", F.size("tokens").alias("held"), apart), "apart")
    # where most of the ball differs from the pivot, the ball is what members are compared with
    most = rows.where("not outer").select(*at, "i", F.explode("apart").alias("token")).groupBy(*at, "i", "token").agg(F.count("*").alias("f")).where("2 * f > i")
    rows = rows.join(most.groupBy(at).agg(F.collect_list("token").alias("most")), at, "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
    rows = rows.withColumn("apart", F.concat(F.array_except("apart", "most"), F.array_except("most", "apart")))
    # a and b are linked just if they have ask(a) + ask(b) differences in common, in units of 1 / 2(100 + num)
    ask = 2 * num * F.col("n").cast("long") - (100 + num) * (F.col("held") - F.size("apart"))
    rows = written(rows.select(*at, "c", "outer", "apart", ask.alias("ask")), "told")
    best = rows.where("not outer").groupBy(at).agg(F.min(F.struct("ask", "c")).alias("best"))
    met = rows.where("outer").join(best, at)
    sure = met.where("ask + best.ask <= 0").select(F.col("c").alias("a"), F.col("best.c").alias("b"))
    bound = met.where("ask + best.ask > 0").groupBy(at).agg(F.min("ask").alias("out_ask"), F.first("best.ask").alias("inn_ask"))
    rows = rows.join(bound, at).withColumn("least", F.ceil((F.col("ask") + F.when(F.col("outer"), F.col("inn_ask")).otherwise(F.col("out_ask"))) / (2 * (100 + num))).cast("int"))
    each = rows.where("least > 0 and size(apart) >= least").select(*at, "c", "outer", "least", F.explode("apart").alias("token"))
    both = each.groupBy(*at, "token").agg(F.count("*").alias("f"), F.count_if("outer").alias("fo")).where("fo > 0 and fo < f").drop("fo")
    first = each.join(both, [*at, "token"]).groupBy(*at, "c", "outer", "least").agg(F.sort_array(F.collect_list(F.struct("f", "token")))["token"].alias("t"))
    first = first.where("size(t) >= least").select(*at, "c", "outer", F.explode(F.slice("t", F.lit(1), F.size("t") - F.col("least") + 1)).alias("token"))
    first = written(first, "first")
    met = first.where("outer").select(*at, "token", F.col("c").alias("a")).join(first.where("not outer").select(*at, "token", F.col("c").alias("b")), [*at, "token"])
    return few.unionByName(sure).unionByName(met.select("a", "b"))


def _round(cells: DataFrame, sets: DataFrame, num: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(links to pivots and deputies, members outside a ball that are not linked to its deputies, members inside, what is left of the cells)."""
    t, eps = 1 - num / 100, 1e-9
    drawn = [F.min_by("cid", F.struct(F.xxhash64("cid", F.lit(4 * seed + i)), "cid")).alias(f"p{i}") for i in range(3)]
    lead = F.max_by("cid", F.struct("central", "cid")).alias("lead")
    chosen = F.when(F.col("m") > SMALL, F.array_distinct(F.array("lead", "p0", "p1", "p2"))).otherwise(F.array("lead"))
    pivots = cells.groupBy("cell").agg(F.count("*").alias("m"), lead, *drawn).select("cell", "lead", chosen.alias("chosen"))
    near = cells.select("cell", "cid", "n", "lone", "central").join(pivots, "cell").withColumn("p", F.explode("chosen")).where("cid <> p")
    known = written(_verified(near.select(F.col("cid").alias("a"), F.col("p").alias("b")).distinct(), sets).withColumn("far", _far()).withColumn("linked", _linked(num)), "pivots")
    near = written(near.join(known.select(F.col("a").alias("cid"), F.col("b").alias("p"), "far", "both", "linked"), ["cid", "p"]), "near")
    # what a pivot's ball and shell hold doesn't depend on the cell: each pair of members meets once for a pivot
    around = near.select("p", "cid", "n", "lone", "far", "both", "linked").distinct()
    inside, outside = F.when(F.col("linked"), F.col("n")), F.when(~F.col("linked"), F.col("far"))
    spare = F.when(F.col("linked"), F.col("n") - F.col("lone") - F.col("both"))
    shell = around.groupBy("p").agg(F.min(outside).alias("least"), F.min(inside).alias("smallest"), F.max(spare).alias("slack")).where("least is not null and smallest is not null")
    around = written(around.join(shell, "p").where(F.when(F.col("linked"), F.col("far") >= F.col("least") - t - eps).otherwise((F.col("far") <= 2 * t + eps) & _hope(num))), "around")
    out = around.where("not linked").select("p", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("lone").alias("la"), F.col("far").alias("fa"), F.col("both").alias("ba"))
    inn = around.where("linked").select("p", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("lone").alias("lb"), F.col("far").alias("fb"), F.col("both").alias("bb"))
    # a ball is one class: who is linked to one of its deputies needs no other member of it
    seat = F.struct("b", "nb", "lb", "fb", "bb")
    drawn = [F.min_by(seat, F.struct("lb", "b")), *(F.min_by(seat, F.struct(F.xxhash64("b", F.lit(4 * seed + i)), "b")) for i in range(3))]
    deputies = inn.groupBy("p").agg(F.array_distinct(F.array(*drawn)).alias("d")).select("p", F.explode("d").alias("d")).select("p", "d.*")
    met = _verified(out.join(deputies, "p").where(_window(num)).select("a", "b").distinct(), sets).where(_linked(num)).select("a", "b")
    met = written(met, "met")
    settled = met.join(deputies.select("p", "b"), "b").select("p", "a").distinct()
    out = written(out.join(settled, ["p", "a"], "left_anti").withColumn("seed", F.lit(seed)), "outer")
    main = F.col("p") == F.col("lead")
    after = near.where(~F.array_contains("chosen", F.col("cid"))).groupBy("cell", "cid").agg(
        F.max("linked").alias("inside"), F.first("n").alias("n"), F.first("lone").alias("lone"), F.first("central").alias("central"),
        F.max(F.when(main, F.col("far"))).alias("f"), F.max(F.when(main, F.col("both"))).alias("w"),
    ).where("not inside").drop("inside")
    more = after.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1").select("cell")
    left = written(after.join(more, "cell"), "cells")
    drop(near)
    return known.where("linked").select("a", "b").unionByName(met), out, inn.withColumn("seed", F.lit(seed)), left


@contained
def links(sets: DataFrame, num: int = 75, rounds: int = ROUNDS) -> DataFrame:
    """Edges (a, b) between ids of sets; the classes they span are those of all links."""
    facts = sets.select("cid", "n", "lone", (F.col("prefix") / F.col("n")).alias("central"))
    cells = _cells(sets.select("cid", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("cell")), facts)
    found, outer, inner, pairs = [], [], [], []
    for seed in range(rounds):
        linked, out, inn, left = _round(cells, sets, num, seed)
        found.append(linked)
        outer.append(out)
        inner.append(inn)
        drop(cells)
        cells = left
        if cells.isEmpty():
            break
    else:
        size = cells.groupBy("cell").agg(F.count("*").alias("m"))
        pairs.append(_direct(cells.join(size.where(f"m <= {LARGE}").select("cell"), "cell"), num))
        large = cells.join(size.where(f"m > {LARGE}").select("cell"), "cell")
        pairs.append(_direct(_cells(_opened(large, sets), facts), num))
    edges = _layers(functools.reduce(DataFrame.unionByName, outer), functools.reduce(DataFrame.unionByName, inner), sets, num)
    for p in pairs:
        edges = edges.unionByName(p)
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = _verified(edges, sets).where(_linked(num)).select("a", "b")
    for f in found:
        edges = edges.unionByName(f)
    return edges


@contained
def jaccard_join(docs: DataFrame, k: int = 5, num: int = 75) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, set_id, component_id: classes of J >= num/100 over k-word shingles."""
    made = written(index(docs, k, num), "sets")
    rows = made.where("kind = 0").select("doc_id", F.col("cid").alias("set_id"), "n")
    sets = made.where("kind = 1").select("cid", "n", "lone", "prefix", "tokens")
    comp = components(links(sets, num), "jaccard")
    least = rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    least = least.join(comp.select(F.col("id").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    # sets without a link keep their own first document; the others take the least of their class
    many = least.groupBy("component").agg(F.min("first").alias("component_id"))
    final = least.join(many, "component").select("set_id", "component_id")
    return rows.join(final, "set_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "set_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("set_id")
