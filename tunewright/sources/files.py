"""Raw files as tables: trees and ZIP archives, their inventory, decoding, and the records in their text."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

#: Suffixes of files that hold records (fixed values).
TEXT_SUFFIXES = ("txt", "rtttl", "rtl", "rtx")
FILES = "source string, content binary, directory boolean"


class _Part(InputPartition):
    def __init__(self, members: list[tuple[str, bool]]) -> None:
        self.members = members


class ArchiveReader(DataSourceReader):
    """Members of a ZIP archive, or the entries of a folder or a single file, without extraction.

    The listing is made on the driver; members are read by the tasks, PER_TASK at a time. Symbolic links yield no bytes.
    """

    PER_TASK = 256

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")

    def _members(self) -> list[tuple[str, bool]]:
        p = Path(self.path)
        if p.is_file() and zipfile.is_zipfile(p):
            with zipfile.ZipFile(p) as z:
                return [(i.filename, i.is_dir()) for i in sorted(z.infolist(), key=lambda i: i.filename)]
        if p.is_dir():
            found = sorted(p.rglob("*"))
            return [(x.relative_to(p).as_posix() + ("/" if x.is_dir() and not x.is_symlink() else ""), x.is_dir() and not x.is_symlink()) for x in found]
        if p.is_file():
            return [(p.name, False)]
        raise FileNotFoundError(self.path)

    def partitions(self) -> list[InputPartition]:
        members = self._members()
        return [_Part(members[i : i + self.PER_TASK]) for i in range(0, len(members), self.PER_TASK)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        p = Path(self.path)
        archive = zipfile.ZipFile(p) if p.is_file() and zipfile.is_zipfile(p) else None
        for name, directory in partition.members:
            if directory:
                data = b""
            elif archive:
                data = archive.read(name)
            else:
                f = p if p.is_file() else p / name
                data = b"" if f.is_symlink() else f.read_bytes()
            yield name, data, directory


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """source, content, directory of a ZIP archive, a folder or a file on storage that every node sees as a folder."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").load(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """source, content, directory of all files below a folder on any storage, by Spark's own distributed listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = "/" + re.sub(r"^\w+:/*", "", path.rstrip("/")).lstrip("/") + "/"
    full = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^\w+:/*", "/")
    inside = F.when(F.startswith(full, F.lit(root)), F.substring(full, F.lit(len(root) + 1), F.length(full))).otherwise(full)
    return files.select(inside.alias("source"), "content", F.lit(False).alias("directory"))


def kind(source: Column, size: Column, directory: Column) -> Column:
    """directory, metadata (system files), empty, text or unsupported."""
    system = F.rlike(source, F.lit(r"(^|/)(__MACOSX(/|$)|\._|\.DS_Store$)"))
    suffix = F.lower(F.regexp_extract(source, r"[^/.][^/]*\.([^./]+)$", 1))
    return F.when(directory, "directory").when(system, "metadata").when(size == 0, "empty").when(suffix.isin(*TEXT_SUFFIXES), "text").otherwise("unsupported")


def inventory(files: DataFrame) -> DataFrame:
    """source, size_bytes, kind, sha256 (null for a folder). Column pruning leaves content out of later steps."""
    size = F.length("content").cast("bigint")
    return files.select("source", size.alias("size_bytes"), kind(F.col("source"), size, F.col("directory")).alias("kind"), F.when(~F.col("directory"), F.sha2("content", 256)).alias("sha256"))


def decode(raw: bytes) -> tuple[str, str, list[str]]:
    """Text, encoding and warnings: UTF-8 with or without a mark, else cp1252, else latin-1, which takes every byte."""
    for codec, name in (("utf-8-sig", "utf-8"), ("cp1252", "cp1252")):
        try:
            return raw.decode(codec), name, [] if name == "utf-8" else [f"decoded_{name}"]
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1"), "latin1", ["decoded_latin1"]


def split_records(text: str) -> list[tuple[int, str, bool]]:
    """First line, text and whether lines were joined, of each record: a line with a colon begins one, others go on with it.

    Blank lines are skipped. A text without any record has one empty record at line 1.
    """
    out: list[tuple[int, list[str]]] = []
    for number, line in enumerate(text.splitlines(), 1):
        if line.strip():
            if ":" in line or not out:
                out.append((number, [line]))
            else:
                out[-1][1].append(line)
    return [(n, "\n".join(lines), len(lines) > 1) for n, lines in out] or [(1, "", False)]


def raw_records(files: DataFrame) -> DataFrame:
    """source, line, kind, encoding, reader_warnings, raw, record_sha256, id, source_sha256 of every record of the files.

    Empty and unsupported files give one row of their kind without text; folders and system files give none. A file is read
    and split in the task that holds it; nothing is shuffled.
    """
    rows = files.withColumn("kind", kind(F.col("source"), F.length("content"), F.col("directory"))).where(~F.col("kind").isin("directory", "metadata"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for source, content, what in zip(*(batch.column(c).to_pylist() for c in ("source", "content", "kind")), strict=True):
                digest = hashlib.sha256(content or b"").hexdigest()
                if what == "text":
                    text, encoding, said = decode(content)
                    found = [(line, "rtttl", encoding, said + ["wrapped_lines_joined"] * joined, raw) for line, raw, joined in split_records(text)]
                else:
                    found = [(1, what, None, [], "")]
                for line, k, encoding, said, raw in found:
                    h = hashlib.sha256(raw.encode("utf-8", "replace")).hexdigest()
                    out.append((source, line, k, encoding, said, raw, h, hashlib.sha256(f"{source}\n{line}\n{h}".encode()).hexdigest()[:20], digest))
            names = ["source", "line", "kind", "encoding", "reader_warnings", "raw", "record_sha256", "id", "source_sha256"]
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    schema = "source string, line int, kind string, encoding string, reader_warnings array<string>, raw string, record_sha256 string, id string, source_sha256 string"
    return rows.select("source", "content", "kind").mapInArrow(run, schema)


def sessionized(lines: DataFrame, key: str, line: str, text: str) -> DataFrame:
    """key, first_line, raw, joined: split_records() for text that is a table of lines already, by a running count of the
    lines that begin a record. One shuffle, by key."""
    kept = lines.where(F.trim(F.col(text)) != "")
    w = Window.partitionBy(key).orderBy(line)
    begins = (F.contains(F.col(text), F.lit(":"))) | (F.row_number().over(w) == 1)
    marked = kept.withColumn("_b", begins.cast("int")).withColumn("record", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(line).alias("l"), F.col(text).alias("t"))))
    grouped = marked.groupBy(key, "record").agg(parts.alias("p"))
    return grouped.select(key, F.element_at("p", 1)["l"].alias("first_line"), F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("raw"), (F.size("p") > 1).alias("joined"))


def zipped(entries: dict[str, bytes]) -> bytes:
    """A ZIP archive with these members; names that end in a slash are folders."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def in_dialect_folder(source: str) -> bool:
    return "rtttl3" in PurePosixPath(source).parts
