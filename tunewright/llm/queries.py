"""The queries of this package's operators. Each takes (spark, folder of the tables) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.llm import crosssplit, encoding, evalleak, forest, merkle, mixture, oracle, spans, splits, truncation

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: f(_table(spark, folder, name))


def _p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign(_table(spark, folder, "songs"), _table(spark, folder, "split_targets"))


def _p3_newest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest batch against a forest of all earlier ones; only the batch's own songs are hashed anew."""
    songs = _table(spark, folder, "songs")
    newest = songs.agg(F.max("batch_no")).first()[0]
    store = forest.HashForest(spark)
    if newest is None:
        return songs.select("rec_no").limit(0)
    store.check(songs.where(F.col("batch_no") < newest))
    store.accept()
    return store.check(songs.where(F.col("batch_no") == newest))


def _leaks(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: f(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def _titles(spark: SparkSession, folder: str, field: str, keep: bool = False) -> DataFrame:
    """The raw records' text, or the songs' names, with what stands in them outside ASCII."""
    if field == "raw":
        return encoding.texts_of(_table(spark, folder, "manifest"), "rec_no", F.col("raw"), "raw", keep)
    return encoding.texts_of(_table(spark, folder, "songs"), "rec_no", F.col("name"), "name", keep)


def _p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.damaged(_titles(spark, folder, "raw"), "rec_no").select("rec_no")


def _p7_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Both fields in one fit: a source's names bear out what happened to its records, and the other way round."""
    texts = _titles(spark, folder, "raw", True).unionByName(_titles(spark, folder, "name", True))
    return encoding.damaged(texts, "rec_no", repair=True)


def _mixture(which: int) -> Query:
    return lambda spark, folder: mixture.plan(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[which]


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on("manifest", lambda m: merkle.copies(m).where("rec_no <> keep_no").select("keep_no", "rec_no")),
        "p1_records": _on("manifest", merkle.records),
        "p2_found": _on("songs", crosssplit.overlaps),
        "p2_counts": _on("songs", crosssplit.overlap_counts),
        "p2_links": _on("songs", crosssplit.links),
        "p2_members": _on("songs", crosssplit.memberships),
        "p3_found": _on("songs", lambda s: forest.repeats(s)),
        "p3_kinds": lambda spark, folder: forest.kinds(_table(spark, folder, "songs"), _table(spark, folder, "manifest")),
        "p3_newest": _p3_newest,
        "p4_found": _on("songs", spans.shared_pairs),
        "p4_spans": _on("songs", spans.shared_spans),
        "p4_coverage": _on("songs", spans.coverage),
        "p5_found": _on("songs", splits.linked_groups),
        "p5_splits": _p5_splits,
        "p5_shares": lambda spark, folder: splits.shares(_table(spark, folder, "songs"), _table(spark, folder, "split_targets")),
        "p7_found": _p7_found,
        "p7_restored": _p7_restored,
        "p7_convergence": lambda spark, folder: encoding.convergence(_titles(spark, folder, "raw")),
        "p8_found": _leaks(evalleak.leaks),
        "p8_items": _leaks(evalleak.leaked_items),
        "p8_cleaned": _leaks(evalleak.cleaned),
        "p9_mixture": _mixture(0),
        "p9_shares": _mixture(1),
        "p10_found": _on("documents", lambda d: truncation.judged(d).where("truncated").select("doc_id")),
        "p10_rates": _on("documents", truncation.rates),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
