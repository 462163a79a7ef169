"""Cutting lineage where a later step must see exactly the rows that an earlier one saw."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. It has to be set on a cluster; on one machine a temporary one will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="veilframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spread(units: DataFrame, keys: list[str]) -> DataFrame:
    """units dealt by their keys over as many tasks as the session has: the texts of one file may lie in one row group, which one task would read alone."""
    spark = units.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return units.repartition(parts, *keys)


def settled(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read again. forget() removes what was written, at the latest at exit."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    _made[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Removes every settled table: they may hold what was found in the texts."""
    for path, spark in list(_made.items()):
        del _made[path]
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(forget)
