"""Tables of a folder, dealt over all cores where they have fewer splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Smaller tables are not worth a shuffle.
LEAST_BYTES = 256 << 10
#: Of a table as it lies compressed, what one task of narrow Python work is given.
TASK_BYTES = 4 << 20


def splits(df: DataFrame) -> int | None:
    """Input splits of a plan without a shuffle, which need no job to be counted."""
    return None if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df.rdd.getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """The same rows for at least as many tasks as there are cores: for narrow work that costs more than a shuffle.

    Of large tables, which have more splits than a cluster has cores, nothing is moved.
    """
    if df.isStreaming or not 0 < (splits(df) or 0) < (cores := df.sparkSession.sparkContext.defaultParallelism):
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size >= LEAST_BYTES else df


def dealt(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """The rows in tasks of a bounded share of the table `of` (of their own, if none is given), however it lies in files and row groups.

    A split reads whole row groups, and joins are coalesced to as many tasks as cores: so some tasks have all rows, or each grows with the table.
    """
    of = df if of is None else of
    if of.isStreaming:
        return df
    size, cores = int(str(of._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-size // TASK_BYTES))) if size >= LEAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
