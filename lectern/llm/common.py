"""Session, storage and graph helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}
_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a local one where it is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="lectern-"))
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if _made:
        _made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that no later plan reads."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _delete(df.sparkSession, f)


def contained(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f with its result written, and every other table that it has written deleted: for results that are small beside them."""

    @functools.wraps(f)
    def run(*args, **more) -> DataFrame:
        _made.append([])
        try:
            result = f(*args, **more)
            spark = result.sparkSession
            inner = _made[-1][:]
            out = written(result, f.__name__)
        finally:
            paths = _made.pop()
        for path in inner:
            _delete(spark, path)
        release(spark)
        if _made:
            _made[-1] += paths[len(inner) :]
        return out

    return run


def release(spark: SparkSession) -> None:
    """Lets the context cleaner remove the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def buckets(spark: SparkSession, least: int = 1) -> int:
    """How many parts to deal a table into; follows the configured shuffle width, which follows the data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): rows (id, component), component the smallest id reached.

    Rounds of large-star and small-star (alternating contraction): each node sends every larger
    neighbour, then every smaller neighbour, to its smallest one. Edges never grow in number, a
    node's neighbours are only aggregated by min, and the table is written every round. Ends when
    a round changes no edge. Ids that have no edge don't appear.
    """
    spark = edges.sparkSession
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = written(e, name)
    seen = None
    for _ in range(max_rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        # large star: neighbours above x go to x's minimum
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours at or below x, and x itself, go to the least of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = written(small, name)
        mark = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        drop(e)
        e = new
        if mark == seen or mark["n"] == 0:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
