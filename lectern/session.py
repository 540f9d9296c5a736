"""Session builder, and what every job needs before it starts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    build = SparkSession.builder.master(master).appName("lectern")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | more
    return build.config(map=conf).getOrCreate()


_own: dict[str, str] = {}


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the session's shared folder and read again, so that later plans begin there and don't grow.

    The folder is spark.checkpoint.dir; a temporary one serves a local session in which it is unset.
    """
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="lectern-"))
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that Python workers can import it."""
    # rows are whole texts: an Arrow batch of the default 10,000 of them is what Python workers would have to hold
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="lectern-"), "lectern.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"lectern/{p.relative_to(root)}")
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    return spark
