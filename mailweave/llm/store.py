"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temp folder only for local masters (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="mailweave-")
    return _LOCAL[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for one intermediate table."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark removes the shuffle files of a query when it ends, if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "zstd") -> str:
    """Write ``df`` to a folder of its own in the shared folder and give its shuffles' disk back; returns the path."""
    conf, path = df.sparkSession.conf, scratch(df.sparkSession, name)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return path


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that survive executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name, codec))


def free(*frames: DataFrame) -> None:
    """Delete the files of written tables that nothing will read again."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for folder in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
