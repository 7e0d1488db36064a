"""Every registered query of the image engine with the SQL that checks it.

The tables hold no images: containers are put together from their columns, and the SQL states the expected answer in
closed form from the same columns, without walking bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native as N
from ..operators import frames as O
from ..operators.rounds import search_rounds

# --- containers made from columns ----------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(text: str) -> Column:
    return F.unhex(F.lit(text))


def _number(value: Column, digits: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), digits, "0"))


def _chunk(kind: str, data: Column) -> Column:
    data = data.cast("binary")
    return F.concat(_number(F.octet_length(data), 8), F.lit(kind).cast("binary"), data, _hex("00000000"))


def _png(text: Column | None, *colour_and_pixels: tuple[str, Column]) -> Column:
    parts = [_hex("89504E470D0A1A0A"), _chunk("IHDR", _hex("00" * 13))]
    parts += [_chunk("tEXt", text)] if text is not None else []
    return F.concat(*parts, *[_chunk(k, d) for k, d in colour_and_pixels], _chunk("IEND", _hex("")))


def _part_png() -> Column:
    return _png(F.concat(F.lit("Comment\0"), F.col("p_name")), ("iCCP", F.col("p_brand")), ("IDAT", F.col("p_type")))


def _segment(marker: str, payload: Column) -> Column:
    return F.concat(_hex(f"FF{marker}"), _number(F.octet_length(payload) + 2, 4), payload)


def _jpeg(*segments: Column) -> Column:
    return F.concat(_hex("FFD8"), *segments, _hex("FFDA00021122FFD9"))


def _customer_jpeg() -> Column:
    exif = _segment("E1", F.concat(_hex("457869660000"), F.col("c_name").cast("binary")))
    icc = _segment("E2", F.concat(_hex("4943435F50524F46494C45000101"), F.col("c_mktsegment").cast("binary")))
    return _jpeg(exif, icc)


# --- queries -------------------------------------------------------------------------------------------------------

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


SQL_CHUNK = "printf('%08X', strlen({0})) || '{1}' || hex({0}) || '00000000'"
HEAD = "'89504E470D0A1A0A' || '0000000D49484452' || repeat('00', 13) || '00000000'"
TAIL = "'0000000049454E4400000000'"
STRIPPED = f"{HEAD} || {SQL_CHUNK.format('p_brand', '69434350')} || {SQL_CHUNK.format('p_type', '49444154')} || {TAIL}"


@query(f"SELECT p_partkey, {STRIPPED} AS stripped, (length({STRIPPED}) / 2)::BIGINT AS bytes FROM part")
def strip_png(spark, sf_dir):
    out = O.strip_png(_part_png())
    return _table(spark, sf_dir, "part").select("p_partkey", out.alias("out")).select("p_partkey", F.hex(F.col("out")).alias("stripped"), F.octet_length("out").cast("long").alias("bytes"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN {STRIPPED} END AS stripped FROM part")
def strip_png_malformed(spark, sf_dir):
    whole, k = _part_png(), F.col("p_partkey") % 4
    lying = F.concat(_hex("89504E470D0A1A0AFFFFFFFF"), F.substring(whole, 13, 1 << 30))
    short = F.substring(whole, F.lit(1), F.octet_length(whole) - 4)
    headless = _png(F.col("p_name"), ("iCCP", F.col("p_brand")))
    made = F.when(k == 0, whole).when(k == 1, lying).when(k == 2, short).otherwise(headless)
    return _table(spark, sf_dir, "part").select("p_partkey", F.hex(O.strip_png(made)).alias("stripped"))


@query("""
WITH s AS (SELECT p_partkey, 8 AS a, 25 AS b, 33 + 20 + strlen(p_name) AS c, 33 + 20 + strlen(p_name) + 12 + strlen(p_brand) AS d, 33 + 20 + strlen(p_name) + 24 + strlen(p_brand) + strlen(p_type) AS e,
  20 + strlen(p_name) AS lt, 12 + strlen(p_brand) AS li, 12 + strlen(p_type) AS ld FROM part)
SELECT p_partkey, 0 AS ord, 'IHDR' AS kind, 8::BIGINT AS "offset", 25::BIGINT AS length FROM s UNION ALL SELECT p_partkey, 1, 'tEXt', 33::BIGINT, lt::BIGINT FROM s
UNION ALL SELECT p_partkey, 2, 'iCCP', c::BIGINT, li::BIGINT FROM s UNION ALL SELECT p_partkey, 3, 'IDAT', d::BIGINT, ld::BIGINT FROM s UNION ALL SELECT p_partkey, 4, 'IEND', e::BIGINT, 12::BIGINT FROM s
""")
def png_chunks(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.inline(O.png_chunks(_part_png())))


@query(f"SELECT p_partkey, {STRIPPED} AS carried FROM part")
def png_colour_carry(spark, sf_dir):
    bare = _png(None, ("IDAT", F.col("p_type")))
    once = _table(spark, sf_dir, "part").select("p_partkey", _part_png().alias("original"), O.carry_colour(_part_png(), bare).alias("once"))
    return once.select("p_partkey", F.hex(O.carry_colour("original", "once")).alias("carried"))


JPEG_STRIPPED = "'FFD8' || 'FFE2' || printf('%04X', 16 + strlen(c_mktsegment)) || '4943435F50524F46494C45000101' || hex(c_mktsegment) || 'FFDA00021122FFD9'"


@query(f"SELECT c_custkey, {JPEG_STRIPPED} AS stripped FROM customer")
def strip_jpeg(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.hex(O.strip_jpeg(F.concat(_customer_jpeg(), F.lit("trailing").cast("binary")))).alias("stripped"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN {JPEG_STRIPPED} END AS stripped FROM customer")
def strip_jpeg_malformed(spark, sf_dir):
    whole, k = _customer_jpeg(), F.col("c_custkey") % 3
    made = F.when(k == 0, whole).when(k == 1, F.concat(F.substring(whole, 1, 4), _hex("FF00"), F.substring(whole, 7, 1 << 30))).otherwise(F.substring(whole, F.lit(1), F.octet_length(whole) - 2))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.hex(O.strip_jpeg(made)).alias("stripped"))


@query("""SELECT c_custkey, 0 AS ord, 225 AS marker, 6::BIGINT AS payload_start, (6 + strlen(c_name))::BIGINT AS length FROM customer
UNION ALL SELECT c_custkey, 1, 226, (16 + strlen(c_name))::BIGINT, (14 + strlen(c_mktsegment))::BIGINT FROM customer""")
def jpeg_segments(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.inline(O.jpeg_segments(_customer_jpeg())))


@query("SELECT c_custkey, 'Exif,ICC_PROFILE' AS found FROM customer")
def metadata_needles(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.array_join(O.needles(_customer_jpeg()), ",").alias("found"))


@query("SELECT doc_id, md5(text) AS profile_md5, strlen(text)::BIGINT AS bytes FROM documents")
def icc_reassembly(spark, sf_dir):
    """Texts as profiles in at most 255 parts of up to 65,519 bytes, numbered by one byte; a text of over 16,707,345 bytes has no such file: null."""
    raw = F.col("text").cast("binary")
    part = F.greatest(F.ceil(F.octet_length(raw) / 255), F.lit(1000)).cast("int")
    n = F.greatest(F.ceil(F.octet_length(raw) / part), F.lit(1)).cast("int")
    one = lambda k: _segment("E2", F.concat(_hex("4943435F50524F46494C4500"), _number(k, 2), _number(n, 2), F.substring(raw, (k - 1) * part + 1, part)))
    backwards = F.transform(F.sequence(n, F.lit(1)), one)
    whole = F.concat(_hex("FFD8"), F.aggregate(backwards, _hex(""), lambda a, x: F.concat(a, x)), _hex("FFDA00021122FFD9"))
    got = _table(spark, sf_dir, "documents").select("doc_id", O.icc_profile(F.when(part <= 65_519, whole)).alias("icc"))
    return got.select("doc_id", F.md5("icc").alias("profile_md5"), F.octet_length("icc").cast("long").alias("bytes"))


@query("SELECT o_orderkey, (o_orderkey % 7 + 2)::INTEGER AS orientation FROM orders")
def orientation_roundtrip(spark, sf_dir):
    """Blocks that say it, some behind a block without the tag, in another byte order or cut short."""
    k, value = F.col("o_orderkey"), _number(F.col("o_orderkey") % 7 + 2, 4)
    block = F.concat(_hex("457869660000" + "4D4D002A00000008" + "0001" + "0112000300000001"), value, _hex("0000" + "00000000"))
    other = F.concat(_hex("457869660000" + "49492A0008000000" + "0100" + "1001030001000000" + "0700" + "0000" + "00000000"))
    files = F.when(k % 3 == 0, _jpeg(_segment("E1", block))).when(k % 3 == 1, _jpeg(_segment("E1", other), _segment("E1", block))).otherwise(_jpeg(_segment("E1", _hex("457869660000" + "4D4D002A")), _segment("E1", other), _segment("E1", block)))
    return _table(spark, sf_dir, "orders").select("o_orderkey", O.orientation(files).alias("orientation"))


NEEDLE = "CASE s_suppkey % 6 WHEN 0 THEN 'hdrgainmap' WHEN 1 THEN 'iso:ts:21496' WHEN 2 THEN 'hdr-gain-map' WHEN 3 THEN 'hdrgm:' WHEN 4 THEN 'GContainer' ELSE 'plain' END"


@query(f"SELECT s_suppkey, 2::BIGINT AS pictures, (16 + strlen({NEEDLE}))::BIGINT AS last_size, s_suppkey % 6 < 5 AS hdr FROM supplier")
def mpf_roundtrip(spark, sf_dir):
    """Attach a second picture, read the index back, and see whether it counts as a gain map."""
    second = _jpeg(_segment("E1", F.concat(F.lit("XX").cast("binary"), F.expr(NEEDLE).cast("binary"))))
    both = O.attach_picture(_jpeg(_segment("E0", F.lit("JFIF").cast("binary"))), second)
    got = _table(spark, sf_dir, "supplier").select("s_suppkey", both.alias("file")).select("s_suppkey", O.picture_ranges("file").alias("r"), O.signals_hdr("file").alias("hdr"))
    return got.select("s_suppkey", F.size("r").cast("long").alias("pictures"), F.element_at("r", -1)["size"].alias("last_size"), "hdr")


@query("""
SELECT vec_id, CASE o WHEN 2 THEN 15 - x WHEN 3 THEN 15 - x WHEN 5 THEN y WHEN 6 THEN 3 - y WHEN 7 THEN 3 - y WHEN 8 THEN y ELSE x END + CASE o WHEN 3 THEN 3 - y WHEN 4 THEN 3 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 15 - x WHEN 8 THEN 15 - x ELSE y END * CASE WHEN o >= 5 THEN 4 ELSE 16 END AS place, v
FROM (SELECT vec_id, vec_id % 8 + 1 AS o, (p - 1) % 16 AS x, (p - 1) // 16 AS y, v FROM (SELECT vec_id, unnest(embedding[1:64])::DOUBLE AS v, generate_subscripts(embedding[1:64], 1) AS p FROM embeddings))
""")
def orient_pixels(spark, sf_dir):
    """Grids of 16 by 4 pixels turned upright."""
    px = _table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 8 + 1).alias("o"), F.posexplode(F.slice("embedding", 1, 64)).alias("p", "v"))
    at = N.oriented_place(F.col("p") % 16, F.floor(F.col("p") / 16), F.lit(16), F.lit(4), F.col("o"))
    return px.select("vec_id", at.alias("at"), "v").select("vec_id", (F.col("at.x") + F.col("at.y") * F.col("at.w")).cast("long").alias("place"), F.col("v").cast("double").alias("v"))


@query("""SELECT l_orderkey, l_linenumber, ((c * a + 26 * (255 - a)) // 255)::BIGINT AS dark, ((c * a + 229 * (255 - a)) // 255)::BIGINT AS light, a <> 255 AS has_alpha
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS c, l_suppkey % 256 AS a FROM lineitem)""")
def composite_alpha(spark, sf_dir):
    c, a = F.col("l_partkey") % 256, F.col("l_suppkey") % 256
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.composite(c, a, F.lit(26)).alias("dark"), N.composite(c, a, F.lit(229)).alias("light"), (a != 255).alias("has_alpha"))


@query("SELECT p_partkey, round(least(greatest(8.30 * exp(0.0285 * (p_retailprice % 100)), 30), 98), 6) AS quality FROM part")
def predict_quality(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(N.predict_quality(F.col("p_retailprice") % 100), 6).alias("quality"))


@query("""SELECT o_orderkey, CASE WHEN w * h > 250000000 THEN 8 WHEN t > 91 THEN 5 WHEN least(w, h) < 113 THEN 4 ELSE 0 END AS code, CASE WHEN w >= h THEN 6 ELSE 0 END AS growth
FROM (SELECT o_orderkey, o_orderkey % 40000 AS w, o_custkey * 37 % 20000 AS h, (o_orderkey % 40 + 60)::DOUBLE AS t FROM orders)""")
def guards(spark, sf_dir):
    w, h, t = F.col("o_orderkey") % 40000, F.col("o_custkey") * 37 % 20000, (F.col("o_orderkey") % 40 + 60).cast("double")
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.guard_code(w, h, t).alias("code"), N.never_grow(w, h).alias("growth"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'unknown' END AS format, p_partkey % 3 < 2 AS ok FROM part")
def format_sniff(spark, sf_dir):
    k, path = F.col("p_partkey") % 4, F.col("p_partkey") % 3
    made = F.when(k == 0, _hex("89504E47")).when(k == 1, _hex("FFD8FFE0")).when(k == 2, _hex("FFD8")).otherwise(F.col("p_name").cast("binary"))
    name = F.concat(F.lit("/a.b/"), F.col("p_name"), F.when(path == 0, ".JPG").when(path == 1, ".png").otherwise(".gif"))
    return _table(spark, sf_dir, "part").select("p_partkey", N.sniff(made).alias("format"), N.extension_ok(name).alias("ok"))


SQL_BYTES = "CASE WHEN {0} < 1024 THEN ({0})::VARCHAR || ' B' WHEN {0} < 1048576 THEN printf('%.1f KB', {0} / 1024.0::DOUBLE) ELSE printf('%.1f MB', {0} / 1048576.0::DOUBLE) END"


@query(f"""SELECT doc_id, {SQL_BYTES.format('o')} || ' to ' || {SQL_BYTES.format('b')} || ', ' || round(100 - 100.0::DOUBLE * b / o)::INTEGER || '% smaller' || CASE WHEN doc_id % 3 = 0 THEN printf(', score %.1f', s) ELSE '' END
  || CASE doc_id % 5 WHEN 0 THEN ', HDR kept' WHEN 1 THEN ', HDR removed' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ', colours reduced' ELSE '' END AS detail
FROM (SELECT doc_id, n_chars * 700 + 1 AS o, n_chars * 7 * (doc_id % 90 + 1) AS b, (doc_id % 100)::DOUBLE + 0.25 AS s FROM documents)""")
def job_detail(spark, sf_dir):
    k, old, new = F.col("doc_id"), F.col("n_chars") * 700 + 1, F.col("n_chars") * 7 * (F.col("doc_id") % 90 + 1)
    score = F.when(k % 3 == 0, (k % 100).cast("double") + 0.25)
    return _table(spark, sf_dir, "documents").select("doc_id", N.detail(old, new, score, F.when(k % 5 == 0, "preserved").when(k % 5 == 1, "dropped").otherwise("absent"), k % 7 == 0).alias("detail"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN greatest(1, least(p_size, floor(0.75 * (p_size * 1000000000.0) / 3000000000.0)::BIGINT)) ELSE p_size END::BIGINT AS jobs FROM part")
def concurrency_limit(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", N.concurrency_limit(F.col("p_partkey") % 2 == 0, F.col("p_size"), F.col("p_size") * F.lit(1e9)).alias("jobs"))


@query("""WITH s AS (SELECT p_partkey, 1000 + p_partkey % 700 AS original, 35.0 + p_partkey % 30 AS base, unnest(range(20, 99)) AS q FROM part),
c AS (SELECT p_partkey, original, q, base + 0.6 * q AS score, q * 12 + p_partkey % 13 AS size FROM s)
SELECT p_partkey, CASE WHEN count(*) FILTER (score >= 80) = 0 THEN 5 WHEN min(size) FILTER (score >= 80) >= any_value(original) THEN 6 ELSE 0 END AS code, (min(q) FILTER (score >= 80))::DOUBLE AS quality FROM c GROUP BY p_partkey""")
def smallest_satisfying(spark, sf_dir):
    """On score curves that rise evenly, the bracketing search finds what trying every quality finds."""
    k, q = F.col("key"), F.col("quality")
    files = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit(80.0).alias("target"), (1000 + F.col("p_partkey") % 700).alias("original"))
    outcomes, _ = search_rounds(files, lambda ask: ask.select("key", (35.0 + k % 30 + 0.6 * q).alias("score"), (q * 12 + k % 13).alias("bytes")), budget=12)
    return outcomes.select(F.col("key").alias("p_partkey"), "code", "quality")


# score and bytes at whole qualities: every fifth curve has an inverted stretch, every seventh never reaches 80, every eleventh is never smaller
CURVE_SCORE = "({k} % 30 + 35.0::DOUBLE + 0.6::DOUBLE * {q} - CASE WHEN {k} % 5 = 0 AND {q} BETWEEN 60 AND 75 THEN 1.5::DOUBLE * ({q} - 60) ELSE 0 END - CASE WHEN {k} % 7 = 0 THEN 45 ELSE 0 END)"
CURVE_SIZE, CURVE_ORIGINAL = "({q} * 12 + {k} % 13)", "(CASE WHEN {k} % 11 = 0 THEN 100 ELSE 1000 + {k} % 700 END)"


def _curve_search(spark, sf_dir):
    """The rounds over the curves of all parts."""
    k, q = F.col("key"), F.col("quality")
    dent = F.when((k % 5 == 0) & q.between(60, 75), 1.5 * (q - 60)).otherwise(0) + F.when(k % 7 == 0, 45).otherwise(0)
    files = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit(80.0).alias("target"), F.when(F.col("p_partkey") % 11 == 0, 100).otherwise(1000 + F.col("p_partkey") % 700).alias("original"))
    return search_rounds(files, lambda ask: ask.select("key", (k % 30 + 35.0 + 0.6 * q - dent).alias("score"), (q * 12 + k % 13).alias("bytes")))


# p: probes so far, as quality and score; a probe gives the next bounds, the next wish and, with it, the next probe or none
@query(f"""WITH RECURSIVE
first AS (SELECT p_partkey AS k, least(greatest(floor(least(greatest(8.30::DOUBLE * exp(0.0285::DOUBLE * 80), 30), 98) + 0.5::DOUBLE), 20), 98)::BIGINT AS q FROM part),
probe AS (
  SELECT k, q, 1 AS n, 20::BIGINT AS lo, 98::BIGINT AS hi, [{{'q': q, 's': {CURVE_SCORE.format(k='k', q='q')}}}] AS p FROM first
  UNION ALL
  SELECT k, nq, n + 1, nlo, nhi, list_append(p, {{'q': nq, 's': {CURVE_SCORE.format(k='k', q='nq')}}}) FROM (
    SELECT *, CASE WHEN NOT list_contains(qs, wq) THEN wq WHEN list_contains(qs, mid) THEN NULL ELSE mid END AS nq FROM (
      SELECT *, least(greatest(floor(want + 0.5::DOUBLE), nlo), nhi)::BIGINT AS wq, floor((nlo + nhi) / 2.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS mid FROM (
        SELECT *, CASE WHEN bs IS NOT NULL AND av IS NOT NULL THEN bq + (80 - bs) / (av - bs) * (aq - bq) WHEN av IS NULL THEN nhi ELSE greatest(q - 8, nlo) END AS want FROM (
          SELECT *, list_transform(p, lambda x: struct_extract(x, 'q')) AS qs,
            list_max(list_transform(below, lambda x: struct_extract(x, 's'))) AS bs, list_min(list_transform(above, lambda x: struct_extract(x, 's'))) AS av,
            list_transform(list_filter(below, lambda x: struct_extract(x, 's') = list_max(list_transform(below, lambda y: struct_extract(y, 's')))), lambda x: struct_extract(x, 'q'))[1] AS bq,
            list_transform(list_filter(above, lambda x: struct_extract(x, 's') = list_min(list_transform(above, lambda y: struct_extract(y, 's')))), lambda x: struct_extract(x, 'q'))[1] AS aq FROM (
            SELECT k, q, n, p, list_filter(p, lambda x: struct_extract(x, 's') < 80) AS below, list_filter(p, lambda x: struct_extract(x, 's') >= 80) AS above,
              CASE WHEN {CURVE_SCORE.format(k='k', q='q')} >= 80 THEN lo ELSE q END AS nlo, CASE WHEN {CURVE_SCORE.format(k='k', q='q')} >= 80 THEN q ELSE hi END AS nhi
            FROM probe WHERE n < 6) WHERE nhi - nlo > 1)))) WHERE nq IS NOT NULL),
tried AS (SELECT k, count(*) AS probes, min(q) FILTER ({CURVE_SCORE.format(k='k', q='q')} >= 80) AS q FROM probe GROUP BY k)
SELECT k AS p_partkey, CASE WHEN q IS NULL THEN 5 WHEN {CURVE_SIZE.format(k='k', q='q')} >= {CURVE_ORIGINAL.format(k='k')} THEN 6 ELSE 0 END AS code, q::DOUBLE AS quality, probes FROM tried""")
def search_choice(spark, sf_dir):
    """The search with its own budget, on curves with inverted stretches, unreachable targets and files that do not get smaller."""
    return _curve_search(spark, sf_dir)[0].select(F.col("key").alias("p_partkey"), "code", "quality", "probes")


@query(f"""SELECT p_partkey, 'png' AS format, CASE WHEN p_partkey % 2 = 0 THEN 'done' ELSE 'failed' END AS state, CASE WHEN p_partkey % 2 = 0 THEN (length({STRIPPED}) / 2)::BIGINT END AS bytes, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS error_code FROM part""")
def optimize_strip(spark, sf_dir):
    whole = _part_png()
    made = F.when(F.col("p_partkey") % 2 == 0, whole).otherwise(F.substring(whole, F.lit(1), F.octet_length(whole) - 1))
    files = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), made.alias("content"))
    return O.optimize_strip(files).select(F.col("path").cast("long").alias("p_partkey"), "format", "state", "bytes", "error_code")
