"""The folder that all executors share, and tables written to it.

A long chain of joins or an iteration is cut by writing a Parquet table there. Unlike a local checkpoint such a
table survives the loss of any executor, and unlike an RDD checkpoint it is compressed, columnar and has statistics.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder given to setCheckpointDir(). Where both are unset and the session runs
    on one machine (tests) a temporary folder of our own; on a cluster that is refused, as executors would each write to their own disk."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder and (set_ := sc._jsc.sc().getCheckpointDir()).isDefined():
        folder = set_.get()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = sc.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tunewright_")
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; what is written there is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        atexit.register(clear, spark, app)
    _written.setdefault(app, []).append(path)
    return path


def clear(spark: SparkSession, app: str | None = None) -> None:
    """Delete all tables written so far. A long-lived session calls it when no result that reads them is needed any more."""
    for path in _written.pop(app or spark.sparkContext.applicationId, []):
        _delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the table that reads it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_block(df: DataFrame, name: str) -> str:
    """Write df, which has a column block, as one folder a block; tasks that hold rows of a block read it with block_rows(), so the
    rows themselves stay where they are."""
    path = new_path(df.sparkSession, name)
    df.repartition("block").write.partitionBy("block").parquet(path)
    return path


def block_rows(path: str, block: int) -> pa.Table | None:
    """What by_block() wrote for a block, in a task; None if it is nothing."""
    files, root = fs.FileSystem.from_uri(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True))
    parts = [pq.read_table(x.path, filesystem=files, partitioning=None) for x in found if x.path.endswith(".parquet")]
    return pa.concat_tables(parts).combine_chunks() if parts else None


def drop(table: DataFrame) -> None:
    """Delete a table written by materialize() that no later plan reads."""
    for f in {x.rpartition("/")[0] for x in table.inputFiles()}:
        _delete(table.sparkSession, f)
