"""Registered queries over the modes, the search and the job queue; see `catalog` for how files are made from tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native as N
from ..functions.report import merged_reports, partial_report, report
from ..operators import frames as O
from ..functions import containers as C
from ..operators import jpeg_codec, png, rounds
from ..operators.reencode import RASTER_TYPE, optimize, optimize_jobs, score_pairs
from ..schema import MAX_PIXELS, MESSAGES
from ..streaming.queue import placement
from .catalog import ORACLES, _chunk, _curve_search, _hex, _jpeg, _number, _png, _segment, _table, query

# --- containers ----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, 'FFD8' || 'FFD0' || 'FF01' || 'FFE2' || printf('%04X', 16 + strlen(c_mktsegment)) || '4943435F50524F46494C45000101' || hex(c_mktsegment) || 'FFDA00021122FFD9' AS stripped, 2::BIGINT AS segments FROM customer")
def strip_jpeg_markers(spark, sf_dir):
    """Markers without a length are walked over, and a strip keeps them."""
    exif = _segment("E1", F.concat(_hex("457869660000"), F.col("c_name").cast("binary")))
    icc = _segment("E2", F.concat(_hex("4943435F50524F46494C45000101"), F.col("c_mktsegment").cast("binary")))
    made = _table(spark, sf_dir, "customer").select("c_custkey", _jpeg(_hex("FFD0"), exif, _hex("FF01"), icc).alias("file"))
    return made.select("c_custkey", F.hex(O.strip_jpeg("file")).alias("stripped"), F.size(O.jpeg_segments("file")).cast("long").alias("segments"))


SECOND = "'FFD8FFE1' || printf('%04X', 4 + strlen(s_name)) || '5858' || hex(s_name) || 'FFDA00021122FFD9'"


@query(f"""SELECT s_suppkey, 'FFD8' || 'FFE00006' || hex('JFIF') || 'FFE20058' || '4D504600' || '4D4D002A00000008' || '0003' || 'B00000070000000430313030' || 'B0010004000000010000000002' || 'B0020007000000200000003200000000'
  || '00030000' || printf('%08X', 108) || '0000000000000000' || '00000000' || printf('%08X', length({SECOND}) // 2) || printf('%08X', 90) || '00000000' || 'FFDA00021122FFD9' || {SECOND} AS file FROM supplier""".replace("B0010004000000010000000002", "B00100040000000100000002"))
def jpeg_attach(spark, sf_dir):
    """A second picture and the index that lists it, byte by byte."""
    second = _jpeg(_segment("E1", F.concat(F.lit("XX").cast("binary"), F.col("s_name").cast("binary"))))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", F.hex(O.attach_picture(_jpeg(_segment("E0", F.lit("JFIF").cast("binary"))), second)).alias("file"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 9 < 5 THEN 'preserved' WHEN s_suppkey % 9 IN (6, 8) THEN 'dropped' ELSE 'absent' END AS hdr, (s_suppkey % 9 < 6 OR s_suppkey % 9 = 8) AS pictures FROM supplier")
def hdr_state(spark, sf_dir):
    """What becomes of an HDR rendition in a strip: in a second picture, said by the first one only (with and without another picture), or not there."""
    k = F.col("s_suppkey") % 9
    note = F.element_at(F.array(*[F.lit(x) for x in ("hdrgainmap", "iso:ts:21496", "hdr-gain-map", "hdrgm:", "GContainer", "plain", "", "", "")]), (k + 1).cast("int"))
    primary = _jpeg(_segment("E0", F.lit("JFIF").cast("binary")))
    both = O.attach_picture(primary, _jpeg(_segment("E1", F.concat(F.lit("http://ns.adobe.com/xap/1.0/\0").cast("binary"), note.cast("binary")))))
    says = _jpeg(_segment("E2", F.lit("urn:iso:std:iso:ts:21496").cast("binary")))
    quiet = O.attach_picture(_jpeg(_segment("E1", F.lit("http://ns.adobe.com/xap/1.0/\0hdrgm:").cast("binary"))), _jpeg(_segment("E0", F.lit("plain").cast("binary"))))
    made = _table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k < 6, both).when(k == 6, says).when(k == 7, primary).otherwise(quiet).alias("content"))
    ranges = F.coalesce(O.picture_ranges("data"), F.array().cast("array<struct<start:bigint,size:bigint>>"))
    return O.strip_display(made).select("s_suppkey", "hdr", (F.size(ranges) > 1).alias("pictures"))


# --- pixels --------------------------------------------------------------------------------------------------------

GRAY = "(floor(abs(v::DOUBLE) * 1000) % 256)::BIGINT"


def _gray(v):
    return (F.floor(F.abs(v.cast("double")) * 1000) % 256).cast("int")


@query(f"SELECT vec_id, (p - 1)::BIGINT AS place, {GRAY} AS v FROM (SELECT vec_id, unnest(embedding[1:64]) AS v, generate_subscripts(embedding[1:64], 1) AS p FROM embeddings)")
def png_codec_roundtrip(spark, sf_dir):
    """Pictures of 16 by 4 gray pixels, encoded as PNG and decoded again."""

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([png.decode(png.encode(np.asarray(x, np.uint8).reshape(4, 16, 1)))[:, :, 0].ravel().astype(int).tolist() for x in rows])

    px = _table(spark, sf_dir, "embeddings").select("vec_id", run(F.transform(F.slice("embedding", 1, 64), _gray)).alias("px"))
    return px.select("vec_id", F.posexplode("px").alias("place", "v")).select("vec_id", F.col("place").cast("long").alias("place"), F.col("v").cast("long").alias("v"))


@query("SELECT l_orderkey, bool_or((l_suppkey * l_partkey) % 4 <> 0) AS has_alpha FROM lineitem GROUP BY l_orderkey")
def has_alpha(spark, sf_dir):
    alphas = F.collect_list(F.lit(255) - (F.col("l_suppkey") * F.col("l_partkey")) % 4)
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(N.has_alpha(alphas).alias("has_alpha"))


#: Pictures in a partition. They cost far more than the rows that they are made from, and whole partitions may be handed over at once.
PICTURES = 256


def _lots(spark, sf_dir) -> int:
    """Partitions that give each some PICTURES suppliers, and each core one."""
    return max(spark.sparkContext.defaultParallelism, -(-_table(spark, sf_dir, "supplier").count() // PICTURES))


def _spread(spark, sf_dir) -> DataFrame:
    """s_suppkey and path of each supplier, in _lots partitions."""
    return _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("path")).repartition(_lots(spark, sf_dir))


TILE = {"png": "binary", "jpeg": "binary", "raster": RASTER_TYPE}


def _tiles(spark, sf_dir, *parts) -> DataFrame:
    """A picture of 120 by 120 pixels, 64 squares of 15 by 15, for each supplier: those of PNG, JPEG and its pixels that parts names."""

    @F.pandas_udf(f"struct<{','.join(f'{k}:{TILE[k]}' for k in parts)}>")
    def run(keys: pd.Series) -> pd.DataFrame:
        out = []
        for key in keys:
            gray = ((key + 1) * (np.arange(64) + 3) * 37 % 256).astype(np.uint8).reshape(8, 8).repeat(15, 0).repeat(15, 1)
            rgb, made = np.stack([gray, gray.T, 255 - gray], axis=2), {}
            if "png" in parts:
                made["png"] = png.encode(rgb, 0)
            if "jpeg" in parts:
                made["jpeg"], seen = jpeg_codec.encode(rgb, 98)
                made["raster"] = {"height": 120, "width": 120, "nChannels": 3, "data": seen[:, :, ::-1].tobytes()}
            out.append([made[k] for k in parts])
        return pd.DataFrame(out, columns=list(parts))

    return _spread(spark, sf_dir).select("path", run("s_suppkey").alias("t")).select("path", "t.*")


def _told(results: DataFrame) -> DataFrame:
    return results.select(F.col("path").cast("long").alias("s_suppkey"), "state", "error_code", (F.col("bytes") < F.col("original_bytes")).alias("smaller"), F.round("score", 3).alias("score"), "quality", F.size("probes").cast("long").alias("probes"))


@query()
def jpeg_fast(spark, sf_dir):
    """One encoding at the fixed quality."""
    return _told(optimize(_tiles(spark, sf_dir, "jpeg", "raster").withColumnRenamed("jpeg", "content"), "fast"))


@query()
def jpeg_quality(spark, sf_dir):
    """The smallest encoding that reaches the target, by the bracketing search."""
    return _told(optimize(_tiles(spark, sf_dir, "jpeg", "raster").withColumnRenamed("jpeg", "content"), "quality"))


@query("""SELECT s_suppkey, 'done' AS state, 100.0::DOUBLE AS score, (225 * sum(v + v + 255 - v))::BIGINT AS pixel_sum
FROM (SELECT s_suppkey, (s_suppkey + 1) * (unnest(range(64)) + 3) * 37 % 256 AS v FROM supplier) GROUP BY s_suppkey""")
def optimize_png(spark, sf_dir):
    """Lossless recompression: smaller files, and every pixel stays, as their sum over all channels shows."""

    @F.pandas_udf("long")
    def total(files: pd.Series) -> pd.Series:
        return pd.Series([int(png.decode(bytes(x))[:, :, :3].sum(dtype=np.int64)) if x is not None else -1 for x in files])

    got = optimize(_tiles(spark, sf_dir, "png").withColumnRenamed("png", "content"), "quality")
    return got.select(F.col("path").cast("long").alias("s_suppkey"), "state", "score", total("data").alias("pixel_sum"))


@query()
def quantize(spark, sf_dir):
    """Colours of smooth pictures reduced to a palette, or refused under the floor."""

    @F.pandas_udf("binary")
    def smooth(keys: pd.Series) -> pd.Series:
        y, x = np.mgrid[0:120, 0:120]
        return pd.Series([png.encode(np.stack([(x * 2 + k) % 256, (y * 2 + k // 256) % 256, (x + y) % 256], axis=2).astype(np.uint8), 0) for k in keys])

    files = _spread(spark, sf_dir).select("path", smooth("s_suppkey").alias("content"))
    return optimize(files, "fast", png_floor=60).select(F.col("path").cast("long").alias("s_suppkey"), "state", "quantized", "error_code", (F.col("bytes") < F.col("original_bytes")).alias("smaller"))


@query("SELECT s_suppkey, 100.0::DOUBLE AS own, true AS lower FROM supplier")
def score(spark, sf_dir):
    """A picture scores 100 against itself and less after an encoding at quality 30."""
    tiles, lots = _tiles(spark, sf_dir, "png"), _lots(spark, sf_dir)

    @F.pandas_udf("binary")
    def worse(files: pd.Series) -> pd.Series:
        return pd.Series([png.encode(jpeg_codec.encode(np.ascontiguousarray(png.decode(bytes(x))[:, :, :3]), 30)[1], 1) for x in files])

    originals = tiles.select("path", F.col("png").alias("content")).repartition(lots, "path")
    other = tiles.select("path", worse("png").alias("content")).repartition(lots, "path")
    own = score_pairs(originals, originals).select("path", F.col("score").alias("own"))
    other = score_pairs(originals, other).select("path", F.col("score").alias("other"))
    return own.join(other, "path").select(F.col("path").cast("long").alias("s_suppkey"), "own", (F.col("other") < 100).alias("lower"))


# --- search --------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, 20 + l_linenumber * 10 AS q, l_quantity AS s FROM lineitem),
b AS (SELECT k, q, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, n) AS r FROM p WHERE s < 25) WHERE r = 1),
a AS (SELECT k, q, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, n) AS r FROM p WHERE s >= 25) WHERE r = 1)
SELECT k AS l_orderkey, round(b.q + (25 - b.s) / (a.s - b.s) * (a.q - b.q), 6) AS quality FROM (SELECT DISTINCT k FROM p) LEFT JOIN a USING (k) LEFT JOIN b USING (k)""")
def interpolate(spark, sf_dir):
    """The next quality to try from the probes so far: the lines of an order are its probes."""
    probes = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), (20 + F.col("l_linenumber") * 10).alias("quality"), F.col("l_quantity").alias("score"))))
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(N.interpolated(probes, F.lit(25.0)), 6).alias("quality"))


@query(ORACLES["search_choice"].rsplit(",\ntried AS", 1)[0] + "\nSELECT k AS p_partkey, n::BIGINT AS probe, q::DOUBLE AS quality FROM probe")
def search_trace(spark, sf_dir):
    """Every probe of the search, in order."""
    return _curve_search(spark, sf_dir)[1].select(F.col("key").alias("p_partkey"), "probe", "quality")


@query("""WITH RECURSIVE m AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem),
c AS (SELECT k, q, (300 + 6 * q + 3 * l_quantity)::DOUBLE / 10 AS s, (q * 12 + floor(l_extendedprice)::BIGINT % 40)::BIGINT AS b FROM m JOIN r ON l_orderkey = k, (SELECT unnest(range(20, 99)) AS q) WHERE i = q % n),
first AS (SELECT k, least(greatest(floor(least(greatest(8.30::DOUBLE * exp(0.0285::DOUBLE * 80), 30), 98) + 0.5::DOUBLE), 20), 98)::BIGINT AS q FROM m),
probe AS (
  SELECT k, q, s, 1 AS n, 20::BIGINT AS lo, 98::BIGINT AS hi, [{'q': q, 's': s}] AS p FROM first JOIN c USING (k, q)
  UNION ALL
  SELECT w.k, nq, c.s, n + 1, nlo, nhi, list_append(p, {'q': nq, 's': c.s}) FROM (
    SELECT *, CASE WHEN NOT list_contains(qs, wq) THEN wq WHEN list_contains(qs, mid) THEN NULL ELSE mid END AS nq FROM (
      SELECT *, least(greatest(floor(want + 0.5::DOUBLE), nlo), nhi)::BIGINT AS wq, floor((nlo + nhi) / 2.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS mid FROM (
        SELECT *, CASE WHEN bs IS NOT NULL AND av IS NOT NULL THEN bq + (80 - bs) / (av - bs) * (aq - bq) WHEN av IS NULL THEN nhi ELSE greatest(q - 8, nlo) END AS want FROM (
          SELECT *, list_transform(p, lambda x: struct_extract(x, 'q')) AS qs,
            list_max(list_transform(below, lambda x: struct_extract(x, 's'))) AS bs, list_min(list_transform(above, lambda x: struct_extract(x, 's'))) AS av,
            list_transform(list_filter(below, lambda x: struct_extract(x, 's') = list_max(list_transform(below, lambda y: struct_extract(y, 's')))), lambda x: struct_extract(x, 'q'))[1] AS bq,
            list_transform(list_filter(above, lambda x: struct_extract(x, 's') = list_min(list_transform(above, lambda y: struct_extract(y, 's')))), lambda x: struct_extract(x, 'q'))[1] AS aq FROM (
            SELECT k, q, n, p, list_filter(p, lambda x: struct_extract(x, 's') < 80) AS below, list_filter(p, lambda x: struct_extract(x, 's') >= 80) AS above,
              CASE WHEN s >= 80 THEN lo ELSE q END AS nlo, CASE WHEN s >= 80 THEN q ELSE hi END AS nhi FROM probe WHERE n < 6) WHERE nhi - nlo > 1)))) w JOIN c ON c.k = w.k AND c.q = nq),
best AS (SELECT k, q, s, b FROM (SELECT probe.k, probe.q, probe.s, c.b, row_number() OVER (PARTITION BY probe.k ORDER BY c.b, n) AS r FROM probe JOIN c USING (k, q) WHERE probe.s >= 80) WHERE r = 1)
SELECT k AS l_orderkey, CASE WHEN best.q IS NULL THEN 5 WHEN b >= 700 + k % 400 THEN 6 ELSE 0 END AS code, best.q::DOUBLE AS quality, round(best.s, 6) AS score, b AS bytes, probes
FROM (SELECT k, count(*) AS probes FROM probe GROUP BY k) LEFT JOIN best USING (k)""")
def search_rounds(spark, sf_dir):
    """The search over curves that are read from a table: an order's lines bend its curve, so a probe is a join by order and line."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.row_number().over(place) - 1).cast("long").alias("i"), "l_quantity", "l_extendedprice")
    curves = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    def probe(ask: DataFrame) -> DataFrame:
        met = ask.join(curves, "key").withColumn("i", F.col("quality").cast("long") % F.col("n")).join(lines, ["key", "i"])
        return met.select("key", ((300 + 6 * F.col("quality") + 3 * F.col("l_quantity")).cast("double") / 10).alias("score"), (F.col("quality") * 12 + F.floor("l_extendedprice") % 40).cast("long").alias("bytes"))

    files = curves.select("key", F.lit(80.0).alias("target"), (700 + F.col("key") % 400).alias("original"))
    outcomes, _ = rounds.search_rounds(files, probe)
    return outcomes.select(F.col("key").alias("l_orderkey"), "code", "quality", F.round("score", 6).alias("score"), "bytes", "probes")


# --- sizes before decoding, jobs of several modes ---------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN k IN (0, 1) THEN p_partkey * 37 + 1 WHEN k IN (2, 3) THEN (p_partkey * 37 + 1) % 65536 END::BIGINT AS width, CASE WHEN k IN (0, 1) THEN p_size * 3000000 WHEN k IN (2, 3) THEN p_size * 300 END::BIGINT AS height,
  CASE k WHEN 0 THEN 16 WHEN 1 THEN 8 WHEN 2 THEN 8 WHEN 3 THEN 12 END AS depth, CASE WHEN k < 4 THEN k = 1 END AS frames,
  CASE WHEN k < 4 THEN (CASE WHEN k IN (0, 1) THEN (p_partkey * 37 + 1)::HUGEINT * p_size * 3000000 ELSE (p_partkey * 37 + 1) % 65536 * p_size * 300 END) > 250000000 END AS too_large FROM (SELECT *, p_partkey % 6 AS k FROM part)""")
def header_dims(spark, sf_dir):
    """Sizes from the headers of PNG (16 bits, animated) and JPEG (behind other segments, in a progressive frame), cut off ones and others."""
    k, w, tall = F.col("p_partkey") % 6, F.col("p_partkey") * 37 + 1, F.col("p_size")
    ihdr = lambda depth: F.concat(_hex("89504E470D0A1A0A"), _chunk("IHDR", F.concat(_number(w, 8), _number(tall * 3000000, 8), _hex(depth + "00000000"))))
    frame = lambda depth: F.concat(_hex(depth), _number(tall * 300, 4), _number(w % 65536, 4), _hex("03"))
    note = _segment("E1", F.concat(F.lit("Exif").cast("binary"), F.col("p_name").cast("binary")))
    made = (
        F.when(k == 0, F.concat(ihdr("10"), _chunk("IDAT", F.col("p_type")), _chunk("IEND", _hex(""))))
        .when(k == 1, F.concat(ihdr("08"), _chunk("acTL", F.col("p_brand")), _chunk("IDAT", F.col("p_type")), _chunk("IEND", _hex(""))))
        .when(k == 2, _jpeg(note, _segment("C0", frame("08")))).when(k == 3, _jpeg(_segment("C2", frame("0C")), note)).when(k == 4, F.substring(ihdr("08"), 1, 20)).otherwise(_jpeg(note))
    )
    d = F.col("d")
    return _table(spark, sf_dir, "part").select("p_partkey", C.header_dims(made).alias("d")).select("p_partkey", d["width"].alias("width"), d["height"].alias("height"), d["depth"].alias("depth"), d["frames"].alias("frames"), (F.try_multiply(d["width"], d["height"]) > MAX_PIXELS).alias("too_large"))


@query("""SELECT o_orderkey, CASE WHEN e THEN 'fast' ELSE ['strip', 'strip', 'strip', 'fast', 'quality', 'quality', 'fast', 'balanced', 'fast', 'quality'][k + 1] END AS mode,
  CASE WHEN e OR k = 0 THEN 'done' WHEN k = 2 THEN 'already_optimal' ELSE 'failed' END AS state, CASE WHEN e THEN 0 ELSE [0, 1, 6, 1, 5, 4, 8, 7, 7, 1][k + 1] END AS error_code, CASE WHEN NOT e AND k IN (4, 5, 9) THEN CASE WHEN k = 4 THEN 95.0 ELSE 80.0 END END::DOUBLE AS target,
  CASE WHEN k = 0 AND NOT e THEN (10 + strlen(o_orderpriority) * 0)::BIGINT END AS stripped
FROM (SELECT *, o_orderkey % 10 AS k, o_orderkey % 50 = 11 AS e FROM orders)""")
def mixed_jobs(spark, sf_dir):
    """Jobs that each have their mode and target: strips, files that are refused before any decoding, modes that do not exist, and some that are encoded."""
    k, encoded = F.col("o_orderkey") % 10, F.col("o_orderkey") % 50 == 11
    sized = lambda side: _jpeg(_segment("C0", F.concat(_hex("08"), _number(F.lit(side), 4), _number(F.lit(side), 4), _hex("03"))), _segment("FE", F.repeat(F.lit("note "), 500).cast("binary")))
    deep = F.concat(_hex("89504E470D0A1A0A"), _chunk("IHDR", _hex("00000008" "00000008" "1000000000")), _chunk("IDAT", _hex("00")), _chunk("IEND", _hex("")))
    bare = _png(None, ("IDAT", F.col("o_orderpriority")))
    content = (
        F.when(encoded, sized(8)).when(k == 0, _jpeg(_segment("E1", F.col("o_orderpriority").cast("binary")))).when(k == 1, F.substring(bare, F.lit(1), F.octet_length(bare) - 1)).when(k == 2, bare)
        .when(k == 3, deep).when(k.isin(4, 5, 9), sized(8)).when(k == 6, sized(60000)).when(k == 7, bare)
    )
    square = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), F.unhex(F.repeat(F.lit("7F"), 192)).alias("data"))
    modes = F.array(*[F.lit(m) for m in ("strip", "strip", "strip", "fast", "quality", "quality", "fast", "balanced", "fast", "quality")])
    jobs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), content.alias("content"), F.when(encoded, "fast").otherwise(F.get(modes, k.cast("int"))).alias("mode"), F.when(k == 4, 95.0).alias("target"), F.when(encoded | k.isin(4, 5), square).alias("raster"))
    got = optimize_jobs(jobs)
    return got.select(F.col("path").cast("long").alias("o_orderkey"), "mode", "state", "error_code", "target", F.when(F.col("mode") == "strip", F.col("bytes")).alias("stripped"))


@query("""WITH RECURSIVE j AS (SELECT l_orderkey // 256 AS g, row_number() OVER (PARTITION BY l_orderkey // 256 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n, floor(l_extendedprice)::BIGINT AS c FROM lineitem),
p AS (
  SELECT g, n, c, c AS held, 0 AS task FROM j WHERE n = 1
  UNION ALL SELECT j.g, j.n, j.c, CASE WHEN p.held + j.c <= 400000 OR p.held = 0 THEN p.held ELSE 0 END + j.c, CASE WHEN p.held + j.c <= 400000 OR p.held = 0 THEN task ELSE task + 1 END FROM p JOIN j ON j.g = p.g AND j.n = p.n + 1)
SELECT g AS job_group, task, count(*) AS jobs, sum(c)::BIGINT AS cost FROM p GROUP BY ALL""")
def job_placement(spark, sf_dir):
    """Jobs of different costs put into tasks that each have room for 400,000: what each task holds."""
    group = F.floor(F.col("l_orderkey") / 256)
    order = Window.partitionBy(group).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    jobs = _table(spark, sf_dir, "lineitem").select(group.alias("group"), F.row_number().over(order).alias("ord"), F.floor("l_extendedprice").alias("cost"))
    placed = placement(jobs, 400_000).join(jobs, ["group", "ord"])
    return placed.groupBy(F.col("group").alias("job_group"), "task").agg(F.count(F.lit(1)).alias("jobs"), F.sum("cost").alias("cost"))


@query("""WITH r AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'strip' WHEN 1 THEN 'fast' ELSE 'quality' END AS mode, l_returnflag AS state, (l_suppkey % 7)::INTEGER AS error_code, (l_partkey * l_quantity)::BIGINT * 97 AS old, CASE WHEN l_suppkey % 4 > 0 THEN floor(l_extendedprice)::BIGINT END AS new FROM lineitem),
c AS (SELECT mode, state, error_code, old, coalesce(new, old) AS new, (old >> greatest(length(bin(old)) - 5, 0)::INTEGER) << greatest(length(bin(old)) - 5, 0)::INTEGER AS cell FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY mode, state, error_code ORDER BY cell) AS n, count(*) OVER (PARTITION BY mode, state, error_code) AS total FROM c)
SELECT mode, state, error_code, count(*) AS files, sum(old)::BIGINT AS old_bytes, sum(new)::BIGINT AS new_bytes, min(cell) FILTER (n >= ceil(total * 0.5)) AS p50, min(cell) FILTER (n >= ceil(total * 0.9)) AS p90 FROM k GROUP BY ALL""")
def report_rollup(spark, sf_dir):
    """A report merged from the states of four passes."""
    line = F.element_at(F.array(F.lit("strip"), F.lit("fast"), F.lit("quality")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    results = _table(spark, sf_dir, "lineitem").select(
        line.alias("mode"), F.col("l_returnflag").alias("state"), (F.col("l_suppkey") % 7).cast("int").alias("error_code"), ((F.col("l_partkey") * F.col("l_quantity")).cast("long") * 97).alias("original_bytes"),
        F.when(F.col("l_suppkey") % 4 > 0, F.floor("l_extendedprice")).alias("bytes"), F.pmod(F.xxhash64("l_orderkey"), F.lit(4)).alias("turn"),
    )
    return report(merged_reports([partial_report(results.where(F.col("turn") == k)) for k in range(4)]))


# --- results and jobs ----------------------------------------------------------------------------------------------

SQL_MESSAGE = " ".join(f"WHEN {k} THEN '{m}'" for k, m in MESSAGES.items())


@query(f"SELECT o_orderkey, CASE o_orderkey % 11 {SQL_MESSAGE} ELSE 'unknown error' END AS message, CASE o_orderkey % 3 WHEN 0 THEN '  hdr gain map preserved' WHEN 1 THEN '  HDR GAIN MAP DROPPED' ELSE '' END AS note, o_orderpriority AS name FROM orders")
def error_codes(spark, sf_dir):
    k = F.col("o_orderkey")
    hdr = F.when(k % 3 == 0, "preserved").when(k % 3 == 1, "dropped").otherwise("absent")
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.error_message((k % 11).cast("int")).alias("message"), N.hdr_note(hdr).alias("note"), N.file_name(F.concat(F.lit("/a/b.c/"), "o_orderpriority")).alias("name"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'already_optimal' ELSE 'failed' END AS state, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 1 ELSE 7 END AS error_code,
  CASE event_id % 4 WHEN 0 THEN (66 + strlen(event_type))::BIGINT + 3 END AS bytes, CASE event_id % 4 WHEN 3 THEN 0 ELSE (66 + strlen(event_type) + 3 + CASE event_id % 4 WHEN 1 THEN 0 WHEN 0 THEN 12 + strlen(props) ELSE -1 END) END::BIGINT AS original_bytes FROM events""".replace("(66 +", "(57 +"))
def job_states(spark, sf_dir):
    """Strip jobs of four kinds: metadata to take away, nothing to take away, cut off, and empty."""
    k, rows = F.col("event_id") % 4, _table(spark, sf_dir, "events")
    pixels = ("IDAT", F.concat(F.lit("px:"), F.col("event_type")))
    bare = _png(None, pixels)
    made = F.when(k == 0, _png(F.col("props"), pixels)).when(k == 1, bare).when(k == 2, F.substring(bare, F.lit(1), F.octet_length(bare) - 1)).otherwise(F.lit(b""))
    got = optimize(rows.select(F.col("event_id").cast("string").alias("path"), made.alias("content")), "strip")
    return got.select(F.col("path").cast("long").alias("event_id"), "state", "error_code", "bytes", "original_bytes")

