"""Session helpers: local sessions, lineage cuts and shipping the package to executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.adaptive.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # else every function call asks for its place in the source
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may leave that unset; it gets one of its own."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_tidemark_dir", None)
    if not there:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, there[7:], ignore_errors=True)
        sc._tidemark_dir = there
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives the loss of executors.

    The result is a fresh relation over the checkpoint's rows. That of ``checkpoint()`` keeps the plan it came from for its
    statistics and constraints, and in a loop those grow with every round, on the driver.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name of our own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that was ours; one that is gone already is no error."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, where its scan has fewer: a small file of one row group is one task.

    Large tables have more splits than cores and are left as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``rank`` (0, 1, ...) in the order given: a range sort and per-partition offsets, in no single task."""
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    offsets, before = [], 0
    for p in sorted(counts):
        offsets += [F.lit(p).cast("int"), F.lit(before).cast("long")]
        before += counts[p]
    rank = F.try_element_at(F.create_map(*offsets), part.cast("int")) + at if offsets else at
    return placed.withColumn("rank", rank.cast("long")).drop("_at")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they need no installed copy."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_ROOT.rglob("*.py")):
            z.write(path, f"{_ROOT.name}/{path.relative_to(_ROOT)}")
    folder = tempfile.mkdtemp(prefix="tidemark-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "tidemark_shipped.zip")
    Path(name).write_bytes(buffer.getvalue())
    sc.addPyFile(name)
    sc._tidemark_shipped = True
