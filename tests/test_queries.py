"""A few registered queries against their SQL, the sink and the queue."""

import hashlib

import duckdb
import pytest

from pixelspark.operators import jpeg
from pixelspark.plans import catalog, modes  # noqa: F401
from pixelspark.sources import files
from pixelspark.streaming import queue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF).collect()
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rows = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in rows.description]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got))) == sorted(map(repr, rows.fetchall()))


def test_long_profiles_are_put_together(spark, tmp_path):
    texts = ["".join(chr(97 + (k * k + k // 7) % 26) for k in range(n)) for n in (0, 254_999, 255_001, 300_000, 1_000_003)] + ["x" * 16_707_346]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["profile_md5"], r["bytes"]) for r in catalog.QUERIES["icc_reassembly"](spark, str(tmp_path)).collect()}
    assert got == {k: (hashlib.md5(t.encode()).hexdigest(), len(t)) for k, t in enumerate(texts[:-1])} | {5: (None, None)}


def test_queue_and_sink(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    whole = b"\xff\xd8" + jpeg.segment(0xE1, b"Exif\0\0camera") + bytes.fromhex("FFDA00021122FFD9")
    (source / "a.jpg").write_bytes(whole)
    (source / "b.txt").write_bytes(b"no image")
    queue.strip_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    results = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["format"], r["state"]) for r in results.collect()} == {("jpeg", "done"), ("unknown", "failed")}
    assert [r["written"] for r in files.replace_in_place(results).collect()] == [True]
    assert (source / "a.jpg").read_bytes() == jpeg.strip(whole) and sorted(p.name for p in source.iterdir()) == ["a.jpg", "b.txt"]
    assert files.read_files(spark, str(source), only_images=True).count() == 1
