"""Tables in the cluster's shared folder, by which jobs cut lineage and survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own where a local session lacks the setting (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"gridloom-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later plans start from the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored() table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def deal(spark: SparkSession) -> int:
    """Number of partitions that the session gives to shuffles: sized with the data by whoever runs the job."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_names(keep: Sequence[str], outputs: Sequence[str]) -> list[str]:
    """Names under which kept columns come back: their own, with a leading _ for each output column of that name."""
    taken, out = {c.lower() for c in outputs}, []
    for c in keep:
        while c.lower() in taken:
            c = f"_{c}"
        taken.add(c.lower())
        out.append(c)
    return out


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lets the session hand Python workers Arrow batches of at most `most` bytes (or one row): texts can be very long.

    The setting stays: results are lazy, and no later plan gives other rows for it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).lower().rstrip("b")) > most:
        spark.conf.set(key, f"{most}b")
