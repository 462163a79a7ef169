"""Dense numbers in a global order, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.lineage import settled

#: Counts of partitions and groups that may be broadcast.
MOST_BROADCAST = 200_000


def numbered(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """rows with name: 1, 2, ... within each group, ascending by order (unique within its group).

    Rows are range-partitioned by (group, order). Each partition counts its rows of a group, the
    counts (one row for each partition and group) are summed up, and a row's number is its place in
    the partition plus what lies in earlier ones. A group that holds most rows is dealt like any other.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, group, order).withColumn("__part", F.spark_partition_id())
    # Which partition a row is in depends on a sample, so it is settled before it is used twice.
    dealt = settled(dealt)
    dealt = dealt.withColumn("__place", F.row_number().over(Window.partitionBy("__part", group).orderBy(order)))
    sizes = dealt.groupBy("__part", group).agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # null is a group as well
    here = (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g"))
    before = F.broadcast(before) if before.count() <= MOST_BROADCAST else before
    out = dealt.join(before.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), "__before"), here)
    return out.withColumn(name, (F.col("__before") + F.col("__place")).cast("bigint")).drop("__part", "__place", "__before", "__p", "__g")
