"""Sinks, jobs, SQL functions, the command line and PNG forms."""

import os
import random
import struct
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark import __main__ as command
from pixelspark import sql
from pixelspark.functions import report
from pixelspark.operators import frames, jpeg, metric, png
from pixelspark.operators.reencode import optimize, score_pairs
from pixelspark.plans import catalog, modes
from pixelspark.sources import files
from pixelspark.streaming import queue

BODY = bytes.fromhex("FFDA00021122FFD9")
NOISY = b"\xff\xd8" + jpeg.segment(0xE1, b"Exif\0\0camera") + BODY


def png_file(w, h, depth, kind, rows, interlace=0, extra=b""):
    return png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlace)) + extra + png.chunk(b"IDAT", zlib.compress(rows)) + png.chunk(b"IEND", b"")


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("interlace", [0, 1])
def test_gray_of_every_depth(depth, interlace):
    h, w = 11, 13
    v = np.random.default_rng(depth).integers(0, 1 << depth, (h, w))
    passes = png.PASSES if interlace else ((0, 0, 1, 1),)
    rows = b""
    for x, y, dx, dy in passes:
        for line in v[y::dy, x::dx]:
            if len(line):
                bits = "".join(f"{n:0{depth}b}" for n in line)
                bits += "0" * (-len(bits) % 8)
                rows += b"\0" + bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
    got = png.decode(png_file(w, h, depth, 0, rows, interlace))
    want = v >> 8 if depth == 16 else v * (255 // ((1 << depth) - 1))
    assert (got[:, :, 0] == want).all() and (got[:, :, 3] == 255).all()


@pytest.mark.parametrize("kind", [3, 4])
def test_left_and_upper_filters_agree_with_a_plain_loop(kind):
    h, w, unit = 9, 14, 3
    lines = np.random.default_rng(1).integers(0, 256, (h, w * unit), np.uint8)
    got = png.unfiltered(np.concatenate([np.full((h, 1), kind, np.uint8), lines], axis=1), unit)
    want = np.zeros((h, w * unit), int)
    for y in range(h):
        for x in range(w * unit):
            a, b = want[y, x - unit] if x >= unit else 0, want[y - 1, x] if y else 0
            c = want[y - 1, x - unit] if y and x >= unit else 0
            p = a + b - c
            guess = (a + b) // 2 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            want[y, x] = (int(lines[y, x]) + guess) % 256
    assert (got == want).all()


@pytest.mark.parametrize("unit", [1, 3])
def test_mixed_filters_agree_with_a_plain_loop_in_one_walk(monkeypatch, unit):
    h, w = 40, 60
    lines, kinds = np.random.default_rng(2).integers(0, 256, (h, w * unit), np.uint8), np.arange(h) * 7 % 5
    steps, paeth = [], png._paeth
    monkeypatch.setattr(png, "_paeth", lambda *x: steps.append(1) or paeth(*x))
    got = png.unfiltered(np.concatenate([kinds[:, None].astype(np.uint8), lines], axis=1), unit)
    want = np.zeros((h, w * unit), int)
    for y in range(h):
        for x in range(w * unit):
            a, b = want[y, x - unit] if x >= unit else 0, want[y - 1, x] if y else 0
            c = want[y - 1, x - unit] if y and x >= unit else 0
            p = a + b - c
            guess = (0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[kinds[y]]
            want[y, x] = (int(lines[y, x]) + guess) % 256
    assert (got == want).all() and len(steps) < h + w
    monkeypatch.setattr(png, "DIAGONAL_ROWS", 6)
    monkeypatch.setattr(png, "DIAGONAL_COLUMNS", 7)
    assert (png.unfiltered(np.concatenate([kinds[:, None].astype(np.uint8), lines], axis=1), unit) == want).all()


def test_clear_colour_and_unknown_filter():
    got = png.decode(png_file(2, 1, 8, 0, b"\0\5\6", extra=png.chunk(b"tRNS", b"\0\5")))
    assert got[0, :, 3].tolist() == [0, 255]
    for bad in (png_file(2, 1, 8, 0, b"\7\5\6"), png_file(2, 1, 8, 0, b"\0\5"), png_file(2, 1, 3, 0, b"\0\5\6")):
        with pytest.raises(png.Refused):
            png.decode(bad)


def test_markers_without_length():
    whole = b"\xff\xd8\xff\xd0" + jpeg.segment(0xE1, b"Exif\0\0x") + b"\xff\x01" + jpeg.segment(0xE2, jpeg.ICC + b"\1\1p") + BODY
    assert [s.marker for s in jpeg.segments(whole)] == [0xE1, 0xE2] and jpeg.icc_profile(whole) == b"p"
    assert jpeg.strip(whole) == b"\xff\xd8\xff\xd0\xff\x01" + jpeg.segment(0xE2, jpeg.ICC + b"\1\1p") + BODY


def test_parameters_that_do_not_fit_are_an_encode_error():
    picture = b"\xff\xd8" + jpeg.segment(0xE1, jpeg.XMP + b"hdrgm:") + BODY
    whole = jpeg.attach(b"\xff\xd8" + BODY, [picture])
    assert jpeg.strip_result(whole)[1:] == ("preserved", 0)
    broken = jpeg.attach(b"\xff\xd8" + BODY, [picture[:-2]])
    assert jpeg.strip_result(broken) == (None, "absent", 2)


def test_column_functions_survive_nulls_and_damage(spark):
    rows = spark.createDataFrame([(1, None, None), (2, bytearray(NOISY), None), (3, bytearray(b"\xff\xd8\xff"), bytearray(NOISY))], "k int, a binary, b binary")
    got = {r["k"]: r for r in rows.select("k", frames.attach_picture("a", "b").alias("both"), frames.strip_jpeg("a").alias("bare"), frames.needles("a").alias("needles"), frames.jpeg_segments("a").alias("segments")).collect()}
    assert got[1]["both"] is None and got[1]["needles"] == [] and got[2]["needles"] == ["Exif"] and bytes(got[2]["bare"]) == jpeg.strip(NOISY) and got[3]["bare"] is None


def test_results_carry_messages_and_details(spark):
    small = png.encode(np.zeros((20, 30, 3), np.uint8), 0)
    rows = spark.createDataFrame([("a", bytearray(NOISY)), ("b", None), ("c", bytearray(small)), ("d", bytearray(b"\xff\xd8 no"))], "path string, content binary")
    got = {r["path"]: r for r in optimize(rows, "strip").collect()}
    assert [got[k]["error_code"] for k in "abcd"] == [0, 7, 6, 1] and got["b"]["error_message"] == "no input was provided"
    assert got["c"]["error_detail"]["best_bytes"] == len(small) and got["a"]["bytes"] == len(jpeg.strip(NOISY))
    assert optimize(rows.limit(0), "quality").count() == 0
    with pytest.raises(ValueError):
        optimize(rows, "balanced")
    quality = {r["path"]: r for r in optimize(rows, "quality").collect()}
    assert quality["c"]["state"] == "done" and quality["c"]["score"] is None and quality["d"]["error_code"] == 1
    scored = score_pairs(rows, rows).collect()
    assert {r["path"]: r["error_code"] for r in scored} == {"a": 1, "b": 7, "c": 4, "d": 1}


def test_pictures_are_never_broadcast(spark, monkeypatch):
    content = F.lit(bytearray(png.encode(np.zeros((120, 120, 3), np.uint8), 0)))
    rows = spark.range(3).select(F.col("id").cast("string").alias("path"), content.alias("content"))
    scored = score_pairs(rows, rows)
    assert "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString() and {r["score"] for r in scored.collect()} == {100}
    monkeypatch.setattr(modes, "PICTURES", 2)
    pictures = modes.score(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[1:]
    assert len(pictures) == 2 and all("BroadcastHashJoin" not in p and p.count(", 5), REPARTITION_BY_NUM") >= 2 for p in pictures)


@pytest.mark.parametrize("name", ["jpeg_quality", "optimize_png", "jpeg_fast", "quantize"])
def test_partitions_hold_few_pictures(spark, monkeypatch, name):
    """However many rows there are: what is made and handed over at once is a partition at most."""
    monkeypatch.setattr(modes, "PICTURES", 2)
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(5), REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1  # of keys, before there are pictures
    made = modes._tiles(spark, "/root/testdata/sf0.001", "jpeg", "raster")
    assert made.columns == ["path", "jpeg", "raster"] and max(len(p) for p in made.select("path").rdd.glom().collect()) <= 3


def test_transparent_pictures_are_judged_over_both_backgrounds():
    a = np.zeros((120, 120, 4), np.uint8)
    b = a.copy()
    b[:, :, :3] = 255  # hidden under full transparency
    assert metric.score_rgba(a, b) == 100


def test_sinks(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.jpg").write_bytes(NOISY)
    os.chmod(tmp_path / "a.jpg", 0o640)
    results = optimize(spark.read.format("binaryFile").load(str(tmp_path)), "strip").persist()
    results.count()
    (tmp_path / "b.jpg").unlink()
    (tmp_path / "c.jpg").write_bytes(NOISY + b"grown")
    got = {r["path"][-5:]: (r["written"], r["problem"] is None) for r in files.replace_in_place(results).collect()}
    assert got == {"a.jpg": (True, True), "b.jpg": (False, False), "c.jpg": (False, True)}
    assert (tmp_path / "a.jpg").read_bytes() == jpeg.strip(NOISY) and os.stat(tmp_path / "a.jpg").st_mode & 0o777 == 0o640
    files.write_beside(results.where("path LIKE '%c.jpg'"), "-small").collect()
    assert (tmp_path / "c-small.jpg").read_bytes() == jpeg.strip(NOISY) and sorted(os.listdir(tmp_path)) == ["a.jpg", "c-small.jpg", "c.jpg"]


def test_jobs(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jpg").write_bytes(NOISY)
    (source / "b.png").write_bytes(b"broken")
    found = spark.read.format("binaryFile").load(str(source))
    jobs = queue.admit(found.union(found), "strip")
    assert jobs.count() == 2 and queue.bounded(jobs, "quality", 8, 8 << 30).rdd.getNumPartitions() == 2
    queue.stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"), "strip", limit=(2, 8 << 30, 1)).awaitTermination()
    results = spark.read.parquet(str(tmp_path / "out"))
    told = {r["path"][-5:]: (r["state"], r["detail"]) for r in queue.states(jobs, results).collect()}
    assert told["a.jpg"][0] == "done" and "smaller" in told["a.jpg"][1] and told["b.png"] == ("failed", "the image could not be decoded")
    assert queue.waiting(jobs, results).count() == 0 and queue.clear(results).count() == 0
    assert {r["state"] for r in queue.states(jobs, results.limit(0)).collect()} == {"waiting"}
    assert queue.clear(results, SimpleNamespace(isActive=True)).count() == 2 and queue.clear(results, SimpleNamespace(isActive=False)).count() == 0


def test_sql_functions(spark):
    names = sql.register(spark)
    spark.createDataFrame([(1, bytearray(NOISY)), (2, None)], "k int, content binary").createOrReplaceTempView("pictures")
    got = spark.sql("SELECT k, s.* FROM pictures, LATERAL image_segments(content) s").collect()
    assert [(r["k"], r["marker"], r["name"], r["tag"]) for r in got] == [(1, "FFE1", "APP1 EXIF/XMP", "Exif")] and "image_strip_jpeg" in names
    assert spark.sql("SELECT image_strip_jpeg(content) AS x FROM pictures WHERE k = 1").first()["x"] == jpeg.strip(NOISY)
    probes = spark.sql("SELECT * FROM image_search(80D, 10000L, transform(sequence(20, 98), q -> 40 + 0.5D * q), transform(sequence(20, 98), q -> CAST(q * 10 AS BIGINT)))").collect()
    assert 1 <= len(probes) <= 6 and min(r["quality"] for r in probes if r["score"] >= 80) <= 81


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.jpg").write_bytes(NOISY)
    (tmp_path / "b.png").write_bytes(png.encode(np.zeros((120, 120, 3), np.uint8), 0))
    place = f"file://{tmp_path}"
    assert command.main([place, "--mode", "strip", "--beside=-s"], spark) == 0
    assert "a.jpg" in capsys.readouterr().out and (tmp_path / "a-s.jpg").exists()
    assert command.main([place, "--mode", "fast"], spark) == 1  # the JPEG has no pixels
    assert "could not be decoded" in capsys.readouterr().out
    assert command.main([place, "--against", place], spark) == 0 and "b.png  score 100.00" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        command.main([place, "--mode", "balanced"], spark)


@pytest.mark.parametrize("lot", [64, 7])
def test_placement_by_cost(spark, monkeypatch, lot):
    monkeypatch.setattr(queue, "LOT", lot)
    draw = random.Random(4)
    rows = [(g, k, draw.randrange(0, 140) if k % 17 else None) for g in range(4) for k in range(150)]
    got = sorted(tuple(r) for r in queue.placement(spark.createDataFrame(rows, "group int, ord long, cost long").repartition(3), 100).collect())
    held, task, last = 0, 0, None
    for (g, k, task_of), (_, _, cost) in zip(got, rows, strict=True):
        if g != last:
            held, task, last = 0, 0, g
        held, task = (held + (cost or 0), task) if held + (cost or 0) <= 100 or held == 0 else (cost or 0, task + 1)
        assert task_of == task, (g, k)
    assert queue.placement(spark.createDataFrame([], "group int, ord long, cost long"), 100).count() == 0


def test_merged_reports_equal_one_at_once(spark, tmp_path, capsys):
    draw = random.Random(2)
    rows = [(draw.choice(("strip", "fast")), draw.choice(("done", "failed")), draw.choice((0, 1)), draw.choice((0, 5, draw.randrange(10**7))), draw.choice((None, draw.randrange(10**5)))) for _ in range(900)] + [(None, None, None, None, None)]
    results = spark.createDataFrame(rows, "mode string, state string, error_code int, original_bytes long, bytes long").withColumn("k", report.F.monotonically_increasing_id() % 3)
    parts = [report.partial_report(results.where(f"k = {k}")) for k in range(3)]
    at_once = sorted(map(str, report.report(report.partial_report(results)).collect()))
    merged = report.report(report.merged_reports([report.merged_reports(parts[:2]), parts[2]]))
    assert sorted(map(str, merged.collect())) == at_once and len(at_once) == 9
    for r in merged.where("mode IS NOT NULL").collect():
        sizes = sorted(o for m, s, e, o, _ in rows if (m, s, e) == (r["mode"], r["state"], r["error_code"]))
        for q, got in ((0.5, r["p50"]), (0.9, r["p90"])):
            true = sizes[-(-int(q * 1000) * len(sizes) // 1000) - 1]
            assert got <= true <= got * 17 / 16
    (tmp_path / "a.jpg").write_bytes(NOISY)
    assert command.main([f"file://{tmp_path}", "--mode", "strip", "--summary"], spark) == 0
    assert "strip done (0): 1 files" in capsys.readouterr().out
