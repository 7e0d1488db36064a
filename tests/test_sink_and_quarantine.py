"""The sink's commit protocol and the quarantine of rows that kill their worker, with injected failures."""

import json
import os
from types import SimpleNamespace

import pytest

from pixelspark.operators import jpeg
from pixelspark.operators.quarantine import answered, fenced
from pixelspark.operators.reencode import optimize
from pixelspark.sources import files, sink

NOISY = b"\xff\xd8" + jpeg.segment(0xE1, b"Exif\0\0camera") + bytes.fromhex("FFDA00021122FFD9")


@pytest.fixture
def results(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(12):
        (folder / f"p{k}.jpg").write_bytes(NOISY + bytes(k))
    found = optimize(spark.read.format("binaryFile").load(f"file://{folder}"), "strip").repartition(4)
    return folder, files.stored(found, f"file://{tmp_path}/results")


def test_a_failing_task_leaves_all_originals(spark, results, tmp_path):
    folder, rows = results
    before = {p.name: p.read_bytes() for p in folder.iterdir()}
    bad = rows.selectExpr("CASE WHEN path LIKE '%p7.jpg' THEN 'file:/nowhere/at/all.jpg' ELSE path END AS path", "* EXCEPT (path)").repartition(3)
    with pytest.raises(Exception, match="nowhere"):
        sink.stage(bad, str(tmp_path / "journal"))
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == before and not os.listdir(tmp_path / "journal")
    assert sink.finish(spark, str(tmp_path / "journal")).count() == 0
    with pytest.raises(Exception, match="journal"):
        sink.stage(rows, "")


def test_replacing_and_running_it_again(spark, results, tmp_path):
    folder, rows = results
    journal = str(tmp_path / "journal")
    os.chmod(folder / "p3.jpg", 0o640)
    (folder / "p5.jpg").write_bytes(b"changed since")
    (folder / "p6.jpg").unlink()
    sink.stage(rows, journal)
    assert (folder / "p0.jpg").read_bytes() == NOISY  # decided, not yet in place
    writer = sink._Writer({"journal": journal})
    writer.commit([])  # a replayed commit changes nothing
    assert len(json.load(open(f"{journal}/COMMITTED"))) >= 1
    got = {os.path.basename(r["path"]): (r["written"], r["problem"]) for r in sink.finish(spark, journal).collect()}
    assert sum(w for w, _ in got.values()) == 10 and got["p5.jpg"] == (False, "the file has changed") and not got["p6.jpg"][0]
    assert all((folder / f"p{k}.jpg").read_bytes() == jpeg.strip(NOISY) for k in range(12) if k not in (5, 6))
    assert os.stat(folder / "p3.jpg").st_mode & 0o777 == 0o640 and len(os.listdir(folder)) == 11
    assert not any(r["written"] for r in sink.finish(spark, journal).collect())
    beside = sink.replace(rows.where("path LIKE '%p5.jpg'").selectExpr("* EXCEPT (original_bytes, modificationTime)", "13L AS original_bytes"), str(tmp_path / "second"), "-small")
    assert [r["written"] for r in beside.collect()] == [True] and (folder / "p5-small.jpg").read_bytes() == jpeg.strip(NOISY)


def test_tags_survive(spark, results, tmp_path):
    folder, rows = results
    try:
        os.setxattr(folder / "p1.jpg", "user.tag", b"red")
    except OSError:
        pytest.skip("no extended attributes here")
    sink.replace(rows, str(tmp_path / "journal"))
    assert sink.tags(f"file://{folder}/p1.jpg") == {"user.tag": b"red"} and (folder / "p1.jpg").read_bytes() == jpeg.strip(NOISY)


def test_results_must_be_stored(results):
    nowhere = SimpleNamespace(sparkSession=SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default)))
    with pytest.raises(ValueError, match="place"):
        files.stored(nowhere)
    assert files.stored(results[1]).inputFiles()[0].startswith("file:")


def test_rows_that_kill_their_worker(spark, tmp_path):
    def work(jobs):
        def run(batches):
            for batch in batches:
                if batch["path"].isin(["p13", "p29"]).any():
                    os._exit(1)
                yield batch

        done = answered(jobs)  # rows of results, as if the work was done
        done = done.withColumn("error_code", (done.original_bytes == 0).cast("int") * 7)
        return done.mapInPandas(run, done.schema)

    jobs = spark.createDataFrame([(f"p{k}", bytearray(NOISY), "strip") for k in range(40)] + [("p5", None, "strip")], "path string, content binary, mode string").repartition(4)
    got = fenced(jobs, f"file://{tmp_path}", work).collect()
    assert sorted(r["path"] for r in got) == sorted([f"p{k}" for k in range(40)] + ["p5"])
    assert {r["path"]: r["error_code"] for r in got if r["error_code"]} == {"p13": 9, "p29": 9, "p5": 7}
    assert [r["state"] for r in got if r["path"] == "p13"] == ["failed"] and fenced(jobs.limit(0), f"file://{tmp_path}").count() == 0

    def broken(jobs):
        return jobs.selectExpr("path", "raise_error('no death') AS x")

    with pytest.raises(Exception, match="no death"):
        fenced(jobs, f"file://{tmp_path}", broken)
