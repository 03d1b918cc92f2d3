"""Session-wide conventions: where lineage is cut, and how Python workers come by this package."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """See to it that Python workers can import this package: unless it is on PYTHONPATH (or, for a local master, in the
    working folder), Spark sends it to them, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        home = Path(__file__).resolve().parents[2]
        seen = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            seen.append(os.getcwd())
        if home not in {Path(p).resolve() for p in seen}:
            sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "kgloom"), "zip", home, "kgloom"))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master (one machine, as in tests) gets a
    folder of ours; anything else raises, as a cluster's machines share no folder that we could know."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "/tmp/kgloom-shared"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: executors may be lost after it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Tables that this session has written to the shared folder: (path, name in the catalog or None).
MADE: list[tuple[str, str | None]] = []


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by Parquet in the shared folder, read again with its own schema: the planner sees the size of its files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    MADE.append((path, None))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that the planner may send to every task.
SENT_ROWS = 100_000


def sized(df: DataFrame) -> DataFrame:
    """A written table that joins shuffle if it has more than SENT_ROWS rows. The planner takes a file's size for a table's, but names are a tenth or less
    in files of what they are in memory: it would have the driver collect tables of a hundred MB and more, one for each join."""
    return df.hint("merge") if df.count() > SENT_ROWS else df


def forget(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written since MADE had so many entries. For callers that have stored what they made from them:
    DataFrames that still read these tables fail afterwards."""
    jvm = spark._jvm
    while len(MADE) > since:
        path, name = MADE.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
