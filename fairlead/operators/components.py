"""Connected components and checkpoint helpers on DataFrames."""

from __future__ import annotations

import re
import tempfile
from functools import cache
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set in a local session, a temporary one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage in the shared checkpoint folder.

    Its files are deleted when nothing refers to the result any more.
    """
    shared_folder(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def afresh(settled: DataFrame) -> DataFrame:
    """The same rows without the sizes and rules that Spark has derived for them: from round to round of a loop
    estimated sizes multiply, up to numbers so long that planning never ends."""
    spark, frame = settled.sparkSession, settled._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(frame.queryExecution().toRdd(), frame.schema(), False), spark)


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to all shuffle partitions; a count that is named is kept, so few but costly rows are not put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@cache
def reaching(spark: SparkSession, parts: int) -> list[int]:
    """For each of so many partitions a number that is dealt to it."""
    found = spark.range(parts * 40).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in sorted(found)]


def dealt_in_turn(df: DataFrame, number: Column, tasks: int) -> DataFrame:
    """Rows dealt by a number: successive numbers to successive tasks, where a hash would put several into one and leave others idle."""
    known = reaching(df.sparkSession, tasks)
    return df.repartition(tasks, F.array(*map(F.lit, known)).cast("array<bigint>")[F.pmod(number, F.lit(len(known))).cast("int")])


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def components(edges: DataFrame) -> DataFrame:
    """Label each node of ``edges(a, b)`` with the least node it can reach.

    ``a`` and ``b`` are integers; nulls and self loops are ignored, repeated
    edges are harmless, and an empty table gives an empty result. Each round
    takes the least label among neighbours. From the third round on a label is
    also replaced by its own label, which halves the length of chains. Labels
    only ever fall, so an unchanged sum means that nothing changed.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = settle(pairs.union(pairs.select("b", "a")).toDF("node", "other").distinct())
    labels = settle(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")))
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    before = labels.agg(total).first()[0]
    if before is None:  # no edges
        return labels
    for k in count():
        told = both.join(labels, "node").select(F.col("other").alias("node"), "component")
        labels = settle(told.union(labels).groupBy("node").agg(F.min("component").alias("component")))
        if k >= 2:
            known = labels.select(F.col("node").alias("component"), F.col("component").alias("least"))
            labels = settle(labels.join(known, "component").select("node", F.col("least").alias("component")))
        after = labels.agg(total).first()[0]
        if after == before:
            return labels
        before = after


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add a gapless number from 0 in the order of some columns, without sorting everything in one task.

    Rows are dealt by range and sorted inside their partitions; the rows in
    earlier partitions are counted (a row for each partition) and added.
    """
    placed = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    joined = placed.join(F.broadcast(starts), "_part")  # as many rows as there are partitions
    return joined.withColumn(name, F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_start")
