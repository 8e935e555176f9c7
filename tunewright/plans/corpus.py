"""Queries over the raw records: parsing and audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.operators import audit

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. One that is stored in fewer pieces than there are cores (a single small file) is dealt out to
    all of them; a larger one is read as it is split, without a shuffle."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) == 1 and cores > 1 and _small(spark, folder, name) else df


def _small(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether the table is smaller than one split."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    length = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return length < spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: f(table(spark, folder, name))


def _p6_found(manifest: DataFrame) -> DataFrame:
    return audit.rejects(manifest.where("kind = 'rtttl'")).select("rec_no")


#: Warnings that the reader of a file gives, not the parser of a record (fixed values).
READER_WARNINGS = ("decoded_cp1252", "decoded_latin1", "wrapped_lines_joined")


def _parse_audit(manifest: DataFrame) -> DataFrame:
    """Every row that has been audited, audited again from its raw."""
    own = F.filter("warnings", lambda w: w.isin(*READER_WARNINGS))
    made = audit.audited(manifest.where("status IS NOT NULL").withColumn("reader_warnings", own), "rec_no")
    return made.select("rec_no", "status", "error", F.array_join("warnings", ",").alias("warnings"), F.col("event_count").cast("bigint").alias("event_count"), "name")


def queries() -> dict[str, Query]:
    return {
        "p6_found": on("manifest", _p6_found),
        "p6_rejects": on("manifest", audit.rejects),
        "p6_songs": on("manifest", audit.newly_accepted),
        "parse_audit": on("manifest", _parse_audit),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "parse_audit": """
            SELECT rec_no, status, error, coalesce(array_to_string(warnings, ','), '') AS warnings,
                   CAST(event_count AS BIGINT) AS event_count, name
            FROM manifest WHERE status IS NOT NULL""",
    }
