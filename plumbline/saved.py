"""Tables saved in the folder that driver and executors share, which cut a job's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session, whose executors are the driver, gets one of its
    own; a cluster must name one.
    """
    own = spark.sparkContext.getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or own
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
    if not own:
        spark.sparkContext.setCheckpointDir(found)
    return found


def write(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder, reread; and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tables_of(df: DataFrame) -> set[str]:
    """Paths of the tables made by ``write`` that df reads."""
    return {m.group() for f in df.inputFiles() if (m := re.match(r".*/plumbline-[0-9a-f]{32}(?=/)", f))}
