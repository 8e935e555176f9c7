"""A key that a third of all rows share is split by adaptive execution in every join that brings rows back to it."""

import pytest
from pyspark.sql import functions as F

from tunewright.operators import dedup, titles
from tunewright.plans import duplicates

N = 30_000


@pytest.fixture
def small_skew(spark):
    """Thresholds at which partitions of a few kilobytes are split, and no broadcast."""
    own = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def rows(spark, *columns):
    """A third of the rows share one value, the others come in pairs."""
    hot = F.col("id") % 3 == 0
    return spark.range(N).repartition(8).withColumn("k", F.when(hot, F.lit(0)).otherwise(F.floor(F.col("id") / 4) + 1)).select(*[c(F.col("id"), F.col("k")) for c in columns])


def split(df):
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_exact_duplicates(spark, small_skew):
    event = lambda p, d: F.struct(p.cast("int").alias("pitch"), F.lit(d).alias("duration"), F.lit(False).alias("dotted"))
    songs = rows(spark, lambda i, k: i.alias("rec_no"), lambda i, k: F.lit(120).alias("bpm"), lambda i, k: F.array(event(60 + k % 48, 4), event(60 + F.floor(k / 48) % 48, 4), event(60 + F.floor(k / 2304) % 48, 4)).alias("events"))
    df = dedup.exact_duplicates(songs)
    assert split(df)
    assert df.count() == N and df.where("is_copy").count() == N - songs.select("events").distinct().count()


def test_copies_of_documents(spark, small_skew):
    docs = rows(spark, lambda i, k: i.alias("doc_id"), lambda i, k: F.concat(F.lit("text "), k.cast("string")).alias("text"))
    df = duplicates._exact_docs(docs)
    assert split(df) and df.where("copies > 5000").count() == N // 3


def test_title_repeats(spark, small_skew):
    word = lambda k: F.translate(k.cast("string"), "0123456789", "abcdefghij")
    named = rows(spark, lambda i, k: i.alias("id"), lambda i, k: F.concat_ws(" ", F.lit("song"), word(k)).alias("title"))
    df = titles.near_repeats(named)
    assert split(df)
    assert df.where("earlier = 0").count() == N // 3 - 1
