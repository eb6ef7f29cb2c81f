"""Tables written to the folder that all executors share: cuts a loop's lineage and survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pathloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """durable(), and how many rows there are, counted as they are written."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def discard(df: DataFrame) -> None:
    """Deletes the files of tables made by durable() that nothing reads any more."""
    found = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for path in [p for p in _written if p.rpartition("/")[2] in found]:
        delete(_written.pop(path), path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before
            return
