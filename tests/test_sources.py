"""Files, records in their text, sinks and streams."""

import io
import wave

import pytest
from pyspark.sql import functions as F

from tunewright.operators import audit
from tunewright.sources import files, sinks
from tunewright.streaming import incremental

ENTRIES = {
    "a/": b"", "a/one.txt": b"Tune:d=4,o=5,b=90:c,d,\ne,f\n\nNext:d=4,o=5,b=90:g\n", "a/rtttl3/two.rtttl": "Caf\xe9:d=4,o=5,b=90:c_".encode("cp1252"), "a/bad.rtx": b"x:d=4,o=5,b=90:c?", "a/empty.txt": b"",
    "a/image.png": b"\x89PNG", "__MACOSX/a/._one.txt": b"junk",
}


@pytest.fixture
def archive(tmp_path):
    p = tmp_path / "corpus.zip"
    p.write_bytes(files.zipped(ENTRIES))
    return p


def test_zip_inventory_and_records(spark, archive):
    read = files.read_archive(spark, str(archive))
    kinds = {r.source: r.kind for r in files.inventory(read).collect()}
    assert kinds == {"a/": "directory", "a/one.txt": "text", "a/rtttl3/two.rtttl": "text", "a/bad.rtx": "text", "a/empty.txt": "empty", "a/image.png": "unsupported", "__MACOSX/a/._one.txt": "metadata"}
    records = files.raw_records(read)
    made = {(r.source, r.line): r for r in audit.audited(records, "source", "line", "id").collect()}
    assert made["a/one.txt", 1].status == "accepted_with_normalization" and made["a/one.txt", 1].event_count == 4
    assert "wrapped_lines_joined" in made["a/one.txt", 1].warnings
    assert made["a/one.txt", 4].status == "accepted"
    assert made["a/rtttl3/two.rtttl", 1].warnings[0] == "decoded_cp1252"
    assert made["a/bad.rtx", 1].error == "invalid_note_syntax"
    assert {made["a/empty.txt", 1].error, made["a/image.png", 1].error} == {"empty_file", "unsupported_file_format"}
    assert all(len(r.id) == 20 for r in made.values()) and len(made) == 6


def test_folder_equals_archive(spark, archive, tmp_path):
    import zipfile

    out = tmp_path / "tree"
    zipfile.ZipFile(archive).extractall(out)
    a = {(r.source, r.sha256) for r in files.inventory(files.read_archive(spark, str(archive))).where("kind <> 'directory'").collect()}
    b = {(r.source, r.sha256) for r in files.inventory(files.read_archive(spark, str(out))).where("kind <> 'directory'").collect()}
    c = {(r.source, r.sha256) for r in files.inventory(files.read_tree(spark, str(out))).collect()}
    assert a == b
    assert c <= a and len(c) >= 4  # Spark's listing leaves out names that begin with _ or .


def test_decode_cascade():
    assert files.decode("﻿é".encode())[:2] == ("é", "utf-8")
    assert files.decode(b"\xe9") == ("é", "cp1252", ["decoded_cp1252"])
    assert files.decode(b"\x81")[1] == "latin1"


def test_lines_equal_files(spark):
    text = "a:b\nc\n\n d\ne:f\n"
    lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(text.split("\n"))], "k long, n long, t string")
    got = sorted((r.first_line, r.raw, r.joined) for r in files.sessionized(lines, "k", "n", "t").collect())
    assert got == files.split_records(text)


def test_wav(spark):
    songs = spark.createDataFrame([(1, 120, [(69, 4, False), (None, 8, True)]), (2, 120, [])], "rec_no long, bpm int, events array<struct<pitch:int,duration:int,dotted:boolean>>")
    rows = {r.rec_no: r for r in sinks.rendered(songs, rate=8000).collect()}
    with wave.open(io.BytesIO(rows[1].wav)) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()) == (8000, 1, 2, 4000 + 3000)
    assert rows[2].wav is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", True), (2, None, False)], "id long, rtttl string, valid boolean")
    assert sinks.write_batch(df, str(tmp_path / "out")) == {"attempts": 2, "valid": 1}
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_json(df, str(tmp_path / "out" / "attempts"))
    back = sinks.read_json(spark, str(tmp_path / "out" / "attempts"), "id long, rtttl string, valid boolean")
    assert sorted(back.collect()) == sorted(df.collect())
    assert sinks.dataset_fingerprint(df) == sinks.dataset_fingerprint(df.orderBy(F.desc("id")))
    assert sinks.dataset_fingerprint(df) != sinks.dataset_fingerprint(df.limit(1))
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "source string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("z", "4")], "source string, sha256 string")
    assert {(r.source, r.problem) for r in sinks.verify(a, b).collect()} == {("y", "changed"), ("z", "missing")}
    assert "&lt;b&gt;" in sinks.listening_page([{"title": "<b>", "rtttl": "x", "file": "f.wav"}])


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, 100, [(60 + i % 3, 4, False)], f"2024-01-0{1 + i % 5} 00:00:00") for i in range(12)], "rec_no long, bpm int, events array<struct<pitch:int,duration:int,dotted:boolean>>, t string")
    rows = rows.withColumn("received_at", F.col("t").cast("timestamp")).drop("t")
    rows.repartition(3).write.parquet(str(tmp_path / "songs"))
    out = incremental.run_once(incremental.first_seen(incremental.stream(spark, str(tmp_path / "songs"), rows.schema)))
    assert out.count() == 3
