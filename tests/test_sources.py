import pytest
from pyspark.sql import types as T

from docloom.operators.records import two_key_upsert
from docloom.sources import files
from docloom.streaming.ingest import new_files, upsert_stream

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("code", T.StringType()), T.StructField("manual", T.BooleanType())])


def test_scan_and_readings(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(b"x" * 100)
    (tmp_path / "in" / "sub" / "b.PDF").write_bytes(b"bad")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")
    found = files.scan(spark, str(tmp_path / "in"))
    assert found.count() == 2 and files.scan(spark, str(tmp_path / "in"), 1).count() == 1

    def read(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode(), 1, "DIGITAL"

    good, dead = files.split_failures(files.readings(found, "DIGITAL_LINEAL", read))
    assert good.count() == 1 and dead.first()["error"] == "ValueError: broken"


def test_unique(spark):
    rows = spark.createDataFrame([(1, "b.pdf"), (2, "a.PDF"), (3, "b.pdf"), (4, "x.doc")], "seq int, path string")
    assert [r["path"] for r in files.unique_paths(rows).orderBy("seq").collect()] == ["b.pdf", "a.PDF"]


def test_store_versions(spark, tmp_path):
    store = files.Store(spark, str(tmp_path / "store"), SCHEMA)
    assert store.version == 0 and store.read().count() == 0
    store.write(spark.createDataFrame([("a", 1, "h", "", False)], SCHEMA))
    assert store.write(two_key_upsert(store.read(), spark.createDataFrame([("b", 1, "h", "", False)], SCHEMA), [])) == 2
    assert [r["id"] for r in store.read().collect()] == ["b"] and [r["id"] for r in store.read(1).collect()] == ["a"]
    store.clear()
    assert store.read().count() == 0
    with pytest.raises(ValueError):
        store.read(9)


def test_unreadable_store_fails(spark, tmp_path):
    store = files.Store(spark, str(tmp_path / "store"), SCHEMA)
    store.write(spark.createDataFrame([("a", 1, "h", "", False)], SCHEMA))
    for part in (tmp_path / "store" / "snapshot").glob("1-*/*.parquet"):
        part.write_bytes(b"junk")
    with pytest.raises(Exception):
        store.read().collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"one")
    store = files.Store(spark, str(tmp_path / "store"), SCHEMA)
    rows = new_files(spark, str(tmp_path / "in")).selectExpr("path as id", "cast(1 as bigint) as seq", "sha256 as hash", "'' as code", "false as manual")
    upsert_stream(rows, store, lambda old, new: two_key_upsert(old, new, []), str(tmp_path / "check")).awaitTermination(60)
    assert store.read().count() == 1


def test_png_size(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x01\x02\x00\x00\x00\x40"
    w, h = files.png_size("c")
    assert tuple(spark.createDataFrame([(bytearray(png),)], "c binary").select(w, h).first()) == (258, 64)
