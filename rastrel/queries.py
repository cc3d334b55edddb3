"""Queries of the raster operators over the fixtures, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.cells import clean_factor, int_list, null_nodata, strip_module
from .operators import attrib, drainage, flood, loader, metrics, mosaic, network, rank, sample, score, smooth, terrain, tiles, windows
from .plans import explain, fixtures, morphometric, predict, prepare, train
from .session import new_folder, staged, unbroadcast
from .sources import catalog, config, patches, rasters, reports, tilefiles, weights

WEIGHTS = [((b % 5) - 2) * 0.25 for b in range(20)]
BIAS = -0.125
BLOCK, CROP = 32, 8
#: Small enough that the fixtures have many tiles.
TILE = 256

# ---- SQL of the fixtures -------------------------------------------------------------------------------------------
DEM = "dem AS (SELECT CAST(o_orderkey // 100 AS INT) r, CAST(o_orderkey % 100 AS INT) c, CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE (1000 - o_orderkey // 100) * 0.0625::DOUBLE + (o_custkey % 16) * 0.0625::DOUBLE END z FROM orders), dims AS (SELECT max(r) + 1 h, max(c) + 1 w FROM dem), jit AS (SELECT r, c, CAST(z + ((r + 2 * c) % 8) * 1e-6::DOUBLE AS FLOAT) z FROM dem)"
FACTOR = "fx AS (SELECT CAST(vec_id // 25 AS INT) r, CAST(vec_id % 25 AS INT) c, CAST(b AS INT) band, embedding[b + 1]::DOUBLE * 2 + 0.5::DOUBLE v FROM embeddings, range(0, 20) t(b)), clean AS (SELECT r, c, band, least(greatest(coalesce(v, 0::DOUBLE), 0::DOUBLE), 1::DOUBLE) v FROM fx)"
LABEL = "lab AS (SELECT CAST(event_id // 100 AS INT) r, CAST(event_id % 100 AS INT) c, CASE WHEN event_type = 'error' THEN 1 WHEN event_type IN ('view', 'purchase') THEN 2 ELSE 0 END code FROM events)"
WRITES = "wr AS (SELECT CAST(l_linenumber AS BIGINT) run, CAST(l_orderkey AS BIGINT) px, l_discount * 10::DOUBLE p, (l_partkey, l_suppkey, l_extendedprice) k FROM lineitem WHERE NOT l_tax > 0.075::DOUBLE), runs AS (SELECT run, px, arg_max(p, k) p FROM wr WHERE p IS NOT NULL GROUP BY 1, 2)"
PRED = "pr AS (SELECT d.doc_id, d.source g, CAST(coalesce(l.quality, -1) AS INT) y, CASE WHEN d.n_chars % 3 = 0 THEN 0 ELSE 1 END pred FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
# 3 x 3 neighbours by place: mirrored (m) and edge (e) indices, so this shares nothing with window functions
NEAR = "offs AS (SELECT a dr, b dc, row_number() OVER (ORDER BY a, b) - 1 k FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b)), nb AS (SELECT j.r, j.c, j.z, o.k, CASE WHEN j.r + dr < 0 THEN least(1, h - 1) WHEN j.r + dr >= h THEN greatest(h - 2, 0) ELSE j.r + dr END mr, CASE WHEN j.c + dc < 0 THEN least(1, w - 1) WHEN j.c + dc >= w THEN greatest(w - 2, 0) ELSE j.c + dc END mc, least(greatest(j.r + dr, 0), h - 1) er, least(greatest(j.c + dc, 0), w - 1) ec, dr, dc FROM jit j, offs o, dims)"
FILLED = "filled AS (SELECT nb.r, nb.c, coalesce(CAST(any_value(nb.z) AS DOUBLE), avg(CAST(m.z AS DOUBLE)), 0::DOUBLE) f FROM nb LEFT JOIN jit m ON m.r = nb.mr AND m.c = nb.mc GROUP BY nb.r, nb.c)"
SLOPE = "grad AS (SELECT nb.r, nb.c, any_value(nb.z) z, sum(m.f * dc * (2 - abs(dr))) / 8 gx, sum(m.f * dr * (2 - abs(dc))) / 8 gy FROM nb JOIN filled m ON m.r = nb.mr AND m.c = nb.mc GROUP BY nb.r, nb.c), slopes AS (SELECT r, c, CASE WHEN z IS NOT NULL THEN CAST(degrees(atan(sqrt(gx * gx + gy * gy))) AS FLOAT) END slope FROM grad)"
FLOW = "ranked AS (SELECT nb.r, nb.c, nb.z - m.z d, [7, 0, 1, 6, NULL, 2, 5, 4, 3][nb.k + 1] dir FROM nb JOIN jit m ON m.r = nb.er AND m.c = nb.ec WHERE nb.k <> 4), best AS (SELECT r, c, max(d) d FROM ranked GROUP BY r, c), flow AS (SELECT b.r, b.c, CAST(CASE WHEN b.d > 0 THEN (SELECT min(dir) FROM ranked x WHERE x.r = b.r AND x.c = b.c AND x.d = b.d) ELSE 255 END AS INT) dir FROM best b), ptrs AS (SELECT r * w + c id, r, c, CASE WHEN dir < 255 AND r + dr BETWEEN 0 AND h - 1 AND c + dc BETWEEN 0 AND w - 1 THEN (r + dr) * w + c + dc END ptr FROM (SELECT r, c, dir, CASE WHEN dir IN (0, 1, 7) THEN -1 WHEN dir IN (3, 4, 5) THEN 1 ELSE 0 END dr, CASE WHEN dir IN (1, 2, 3) THEN 1 WHEN dir IN (5, 6, 7) THEN -1 ELSE 0 END dc FROM flow), dims)"
UP = "up AS (SELECT id src, id here FROM ptrs UNION ALL SELECT up.src, p.ptr FROM up JOIN ptrs p ON p.id = up.here WHERE p.ptr IS NOT NULL), acc AS (SELECT here id, count(*) acc, CAST(sum(coalesce(CAST(s.slope AS DOUBLE), 0::DOUBLE)) / count(*) AS FLOAT) beta FROM up JOIN ptrs p ON p.id = up.src JOIN slopes s ON s.r = p.r AND s.c = p.c GROUP BY here), roots AS (SELECT src id, arg_max(here, n) root FROM (SELECT up.src, up.here, a.acc n FROM up JOIN acc a ON a.id = up.here) GROUP BY src), units AS (SELECT p.id, p.r, p.c, p.ptr, CAST(CASE WHEN p.ptr IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY p.ptr IS NULL ORDER BY o.root) END AS INT) label FROM ptrs p JOIN roots o ON o.id = p.id)"
JOINT = "cells AS (SELECT u.*, s.slope, a.acc, a.beta FROM units u JOIN slopes s ON s.r = u.r AND s.c = u.c JOIN acc a ON a.id = u.id), jp AS (SELECT r, c, label, cdf_beta, cdf_acc, CAST(cdf_beta * cdf_acc AS FLOAT) j FROM (SELECT r, c, label, CASE WHEN n <= 1 THEN 0::DOUBLE ELSE (rank() OVER (ORDER BY beta) + (count(*) OVER (PARTITION BY beta) - 1) / 2::DOUBLE - 1) / (n - 1) END cdf_beta, CASE WHEN n <= 1 THEN 0::DOUBLE ELSE (rank() OVER (ORDER BY acc) + (count(*) OVER (PARTITION BY acc) - 1) / 2::DOUBLE - 1) / (n - 1) END cdf_acc FROM (SELECT *, count(*) OVER () n FROM cells WHERE slope >= 0))), umax AS (SELECT label, greatest(0::FLOAT, max(j)) v FROM jp WHERE label > 0 GROUP BY label), psl AS (SELECT c.r, c.c, CASE WHEN c.slope IS NOT NULL THEN coalesce(u.v, 0::FLOAT) END p FROM cells c LEFT JOIN umax u ON u.label = c.label)"
GAUSS = "kern AS (SELECT o, exp(-0.125::DOUBLE * o * o) / sum(exp(-0.125::DOUBLE * o * o)) OVER () k FROM range(-8, 9) t(o)), g1 AS (SELECT s.r, s.c, sum(kern.k * coalesce(CAST(n.v AS DOUBLE), 0::DOUBLE)) v FROM src s CROSS JOIN kern CROSS JOIN dims JOIN src n ON n.r = s.r AND n.c = CASE WHEN (s.c + o + 2 * w) % (2 * w) < w THEN (s.c + o + 2 * w) % (2 * w) ELSE 2 * w - 1 - (s.c + o + 2 * w) % (2 * w) END GROUP BY s.r, s.c), g2 AS (SELECT s.r, s.c, sum(kern.k * n.v) v FROM g1 s CROSS JOIN kern CROSS JOIN dims JOIN g1 n ON n.c = s.c AND n.r = CASE WHEN (s.r + o + 2 * h) % (2 * h) < h THEN (s.r + o + 2 * h) % (2 * h) ELSE 2 * h - 1 - (s.r + o + 2 * h) % (2 * h) END GROUP BY s.r, s.c)"
W_SQL = "w AS (SELECT CAST(b AS INT) band, ((b % 5) - 2) * 0.25::DOUBLE wt FROM range(0, 20) t(b))"
KEY = "((CAST(r AS BIGINT) * 100 + c) * 7919 + 104729) % 65537"
BALANCED = f"bal AS (SELECT r, c, code FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {KEY}, r, c) rn, count(*) FILTER (code = 1) OVER () slides FROM lab WHERE code IN (1, 2)) WHERE code = 1 OR rn <= slides)"
KEPT = "kept AS (SELECT r, c, code, CAST(r // 32 * 32 AS INT) block_r, CAST(c // 32 * 32 AS INT) block_c FROM bal, (SELECT max(r) + 1 h, max(c) + 1 w FROM lab) WHERE r - 4 >= r // 32 * 32 AND r + 4 <= r // 32 * 32 + least(32, h - r // 32 * 32) AND c - 4 >= c // 32 * 32 AND c + 4 <= c // 32 * 32 + least(32, w - c // 32 * 32) AND least(32, h - r // 32 * 32) >= 8 AND least(32, w - c // 32 * 32) >= 8)"


def _r(c: str, digits: int = 6):
    return F.round(F.col(c).cast("double"), digits).alias(c)


def _size(cells: DataFrame) -> tuple[int, int]:
    return rasters.bounds(cells)


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.factors(spark, sf_dir)
    return d.withColumn("v", clean_factor(F.col("v")))


def _drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = fixtures.dem(spark, sf_dir)
    return morphometric.drained(dem, *_size(dem), morphometric.Settings(tile=TILE))


def _joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphometric.joint(_drained(spark, sf_dir))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {FACTOR} SELECT * FROM clean")
def clean_factors(spark, sf_dir):
    return _clean(spark, sf_dir)


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END v FROM events")
def nodata_to_null(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("CASE WHEN event_id % 14 = 0 THEN double('NaN') WHEN event_id % 7 = 0 THEN -9999D ELSE CAST(event_id AS DOUBLE) END").alias("v"))
    return d.select("event_id", null_nodata(F.col("v")).alias("v"))


@query(f"WITH {DEM} SELECT r, c, coalesce(z, -9999::DOUBLE) z FROM dem WHERE r >= 3 AND r < 11 AND c >= 20 AND c < 60")
def windowed_scan(spark, sf_dir):
    path = new_folder(spark, "dem")
    rasters.write(fixtures.dem(spark, sf_dir), path, value="z")
    return rasters.read(spark, path, (3, 11, 20, 60)).select("r", "c", F.col("z").cast("double").alias("z"))


@query(f"WITH {FACTOR} SELECT r, c, band, coalesce(CAST(CAST(v AS FLOAT) AS DOUBLE), -9999::DOUBLE) v FROM (SELECT r, c, band, CASE WHEN (r + c) % 5 <> 0 THEN v END v FROM fx)")
def raster_sink(spark, sf_dir):
    """Single-precision values with nodata for missing ones, as they are read back."""
    path = new_folder(spark, "factors")
    cells = fixtures.factors(spark, sf_dir)
    rasters.write(cells.withColumn("v", F.when((F.col("r") + F.col("c")) % 5 != 0, F.col("v"))), path)
    return rasters.read(spark, path).select("r", "c", "band", F.col("v").cast("double").alias("v"))


@query(f"WITH {FACTOR} SELECT r, c, count(*) n_bands, round(sum(v * (band + 1)), 6) weighted, min_by(v, band) first_v, max_by(v, band) last_v FROM clean GROUP BY r, c")
def band_stack(spark, sf_dir):
    d = score.band_stack(_clean(spark, sf_dir))
    weighted = F.aggregate(F.transform("f", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return d.select("r", "c", F.size("f").cast("long").alias("n_bands"), F.round(weighted, 6).alias("weighted"), F.get("f", F.lit(0)).alias("first_v"), F.element_at("f", -1).alias("last_v"))


@query(f"WITH {DEM} SELECT r, c, CAST(z AS DOUBLE) z FROM jit")
def dem_jitter(spark, sf_dir):
    return terrain.jitter(fixtures.dem(spark, sf_dir)).withColumn("z", F.col("z").cast("double"))


@query(f"WITH {DEM} SELECT r, c, CAST(CAST(z + 200 + ((r + 2 * c) % 8) * 1e-6::DOUBLE AS FLOAT) AS DOUBLE) z FROM dem")
def dem_jitter_high(spark, sf_dir):
    return terrain.jitter(fixtures.dem(spark, sf_dir).withColumn("z", F.col("z") + 200)).withColumn("z", F.col("z").cast("double"))


@query(f"WITH {DEM}, {NEAR}, {FILLED} SELECT r, c, round(f, 6) filled FROM filled")
def nodata_fill(spark, sf_dir):
    return terrain.fill_missing(terrain.jitter(fixtures.dem(spark, sf_dir))).select("r", "c", _r("filled"))


@query(f"WITH {DEM}, {NEAR}, {FILLED}, {SLOPE} SELECT r, c, round(CAST(slope AS DOUBLE), 4) slope FROM slopes")
def sobel_slope(spark, sf_dir):
    return terrain.sobel_slope(terrain.jitter(fixtures.dem(spark, sf_dir))).select("r", "c", _r("slope", 4))


@query(f"WITH {DEM}, {NEAR}, {FLOW} SELECT r, c, dir FROM flow")
def d8_direction(spark, sf_dir):
    return terrain.d8(terrain.jitter(fixtures.dem(spark, sf_dir)))


@query(f"WITH {DEM}, {NEAR}, {FLOW} SELECT CAST(id AS BIGINT) id, CAST(ptr AS BIGINT) ptr FROM ptrs")
def receivers(spark, sf_dir):
    dem = fixtures.dem(spark, sf_dir)
    return terrain.receivers(terrain.d8(terrain.jitter(dem)), *_size(dem))


@query(f"WITH RECURSIVE {DEM}, {NEAR}, {FILLED}, {SLOPE}, {FLOW}, {UP} SELECT p.r, p.c, acc FROM acc JOIN ptrs p ON p.id = acc.id")
def flow_accumulation(spark, sf_dir):
    return _drained(spark, sf_dir).select("r", "c", "acc")


@query(f"WITH RECURSIVE {DEM}, {NEAR}, {FILLED}, {SLOPE}, {FLOW}, {UP} SELECT p.r, p.c, round(CAST(beta AS DOUBLE), 4) beta FROM acc JOIN ptrs p ON p.id = acc.id")
def mean_upstream_slope(spark, sf_dir):
    return _drained(spark, sf_dir).select("r", "c", _r("beta", 4))


@query(f"WITH RECURSIVE {DEM}, {NEAR}, {FILLED}, {SLOPE}, {FLOW}, {UP} SELECT r, c, label FROM units")
def slope_units(spark, sf_dir):
    return drainage.unit_labels(staged(_drained(spark, sf_dir), "drained-cells")).select("r", "c", "label")


@query(f"WITH RECURSIVE {DEM}, {NEAR}, {FILLED}, {SLOPE}, {FLOW}, {UP}, {JOINT} SELECT r, c, round(cdf_acc, 6) cdf_acc, round(cdf_beta, 4) cdf_beta, round(CAST(j AS DOUBLE), 4) joint FROM jp")
def joint_cdf(spark, sf_dir):
    return _joint(spark, sf_dir).select("r", "c", _r("cdf_acc"), _r("cdf_beta", 4), _r("joint", 4))


@query(f"WITH RECURSIVE {DEM}, {NEAR}, {FILLED}, {SLOPE}, {FLOW}, {UP}, {JOINT} SELECT label, round(CAST(v AS DOUBLE), 4) unit_value FROM umax")
def unit_max(spark, sf_dir):
    return rank.unit_maximum(_joint(spark, sf_dir)).select("label", _r("unit_value", 4))


@query(f"WITH RECURSIVE {DEM}, {NEAR}, {FILLED}, {SLOPE}, {FLOW}, {UP}, {JOINT} SELECT r, c, round(CAST(p AS DOUBLE), 4) ps_l FROM psl")
def morphometric_index(spark, sf_dir):
    dem = fixtures.dem(spark, sf_dir)
    return morphometric.susceptibility(dem, *_size(dem)).select("r", "c", _r("ps_l", 4))


@query(f"WITH {DEM}, src AS (SELECT r, c, z v FROM dem), {GAUSS} SELECT s.r, s.c, CASE WHEN s.v IS NOT NULL THEN round(g2.v, 6) END v FROM src s JOIN g2 ON g2.r = s.r AND g2.c = s.c")
def gauss_smooth(spark, sf_dir):
    return smooth.gaussian(fixtures.dem(spark, sf_dir).withColumnRenamed("z", "v"), 2.0).select("r", "c", _r("v"))


@query(f"WITH RECURSIVE {DEM}, {NEAR}, {FILLED}, {SLOPE}, {FLOW}, {UP}, {JOINT}, src AS (SELECT r, c, p v FROM psl), {GAUSS} SELECT s.r, s.c, CASE WHEN s.v IS NOT NULL THEN round(g2.v, 3) END ps_l FROM src s JOIN g2 ON g2.r = s.r AND g2.c = s.c")
def morphometric_smoothed(spark, sf_dir):
    dem = fixtures.dem(spark, sf_dir)
    return morphometric.susceptibility(dem, *_size(dem), morphometric.Settings(sigma=2.0)).select("r", "c", _r("ps_l", 3))


@query(f"WITH {DEM}, {NEAR}, {FILLED}, {SLOPE}, {FLOW} SELECT f.r, f.c, round(CAST(slope AS DOUBLE), 4) slope, dir FROM slopes s JOIN flow f ON f.r = s.r AND f.c = s.c")
def tile_terrain(spark, sf_dir):
    """Slope and direction on tiles of 32 x 32 cells."""
    dem = fixtures.dem(spark, sf_dir)
    h, w = _size(dem)
    made = tiles.terrain(tiles.from_cells(dem, ["z"], h, w, 32), h, w, tile=32)
    return tiles.to_cells(made, ["slope", "dir"]).select("r", "c", _r("slope", 4), F.col("dir").cast("int").alias("dir"))


@query(f"WITH {DEM}, src AS (SELECT r, c, z v FROM dem), {GAUSS} SELECT s.r, s.c, CASE WHEN s.v IS NOT NULL THEN round(g2.v, 6) END v FROM src s JOIN g2 ON g2.r = s.r AND g2.c = s.c")
def tile_gauss(spark, sf_dir):
    """Smoothing on tiles of 32 x 32 cells."""
    dem = fixtures.dem(spark, sf_dir).withColumnRenamed("z", "v")
    h, w = _size(dem)
    return tiles.to_cells(tiles.gaussian(tiles.from_cells(dem, ["v"], h, w, 32), "v", h, w, tile=32), ["v"]).select("r", "c", _r("v"))


@query(f"WITH RECURSIVE {DEM}, {NEAR}, {FILLED}, {SLOPE}, {FLOW}, {UP} SELECT p.r, p.c, acc, round(CAST(beta AS DOUBLE), 4) beta, CAST(root AS BIGINT) root FROM acc JOIN ptrs p ON p.id = acc.id JOIN roots o ON o.id = p.id")
def tile_drainage(spark, sf_dir):
    """Accumulation and roots with paths that run over tiles of 32 x 32 cells."""
    dem = fixtures.dem(spark, sf_dir)
    return morphometric.drained(dem, *_size(dem), morphometric.Settings(tile=32)).select("r", "c", "acc", _r("beta", 4), "root")


@query(f"WITH RECURSIVE {DEM}, offs AS (SELECT a dr, b dc FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b)), seed AS (SELECT d.r, d.c, any_value(d.z) z FROM dem d CROSS JOIN offs LEFT JOIN dem n ON n.r = d.r + dr AND n.c = d.c + dc WHERE d.z IS NOT NULL AND n.z IS NULL GROUP BY d.r, d.c), fill(r, c, f) USING KEY (r, c) AS (SELECT r, c, z FROM seed UNION SELECT n.r, n.c, min(greatest(n.z, w.f)) FROM fill w CROSS JOIN offs JOIN dem n ON n.r = w.r + dr AND n.c = w.c + dc LEFT JOIN recurring.fill o ON o.r = n.r AND o.c = n.c WHERE n.z IS NOT NULL AND (o.f IS NULL OR greatest(n.z, w.f) < o.f) GROUP BY n.r, n.c) SELECT d.r, d.c, fill.f z FROM dem d LEFT JOIN fill ON fill.r = d.r AND fill.c = d.c")
def depression_fill(spark, sf_dir):
    """Depressions filled, with spills over the borders of tiles of 32 x 32 cells."""
    dem = fixtures.dem(spark, sf_dir)
    return flood.fill(dem, *_size(dem), 32)


@query(f"WITH {DEM}, t AS (SELECT CAST(a AS INT) r0, least(CAST(a AS INT) + 64, h) r1, CAST(b AS INT) c0, least(CAST(b AS INT) + 64, w) c1, h, w FROM dims, range(0, 100000, 64) x(a), range(0, 1000, 64) y(b) WHERE a < h AND b < w) SELECT r0, r1, c0, c1, greatest(r0 - 8, 0) h_r0, least(r1 + 8, h) h_r1, greatest(c0 - 8, 0) h_c0, least(c1 + 8, w) h_c1 FROM t")
def tile_windows(spark, sf_dir):
    return windows.tiles(spark, *_size(fixtures.dem(spark, sf_dir)), tile=64, overlap=8)


@query(f"WITH {DEM}, ov AS (SELECT unnest([3, 7, 11]) overlap) SELECT overlap, CAST(a * (32 - overlap) AS INT) r, CAST(b * (32 - overlap) AS INT) c, CAST(least(32, h - a * (32 - overlap)) AS INT) h, CAST(least(32, w - b * (32 - overlap)) AS INT) w FROM ov, dims, range(0, 10000) x(a), range(0, 100) y(b) WHERE a * (32 - overlap) < h - overlap AND b * (32 - overlap) < w - overlap")
def pred_windows(spark, sf_dir):
    return windows.prediction_windows(spark, *_size(fixtures.dem(spark, sf_dir)), crop=32, overlaps=[3, 7, 11])


@query(f"WITH {DEM}, ov AS (SELECT unnest([3, 7, 11]) overlap), win AS (SELECT overlap, a * (32 - overlap) r, b * (32 - overlap) c FROM ov, dims, range(0, 10000) x(a), range(0, 100) y(b) WHERE a * (32 - overlap) < h - overlap AND b * (32 - overlap) < w - overlap) SELECT v.overlap, d.r, d.c, CAST(max(v.r) AS INT) own_r, CAST(max(v.c) AS INT) own_c FROM dem d JOIN win v ON d.r BETWEEN v.r AND v.r + 31 AND d.c BETWEEN v.c AND v.c + 31 GROUP BY v.overlap, d.r, d.c")
def window_owner(spark, sf_dir):
    dem = fixtures.dem(spark, sf_dir)
    h, w = _size(dem)
    d = dem.withColumn("overlap", F.explode(F.array(F.lit(3), F.lit(7), F.lit(11))))
    return d.select("overlap", "r", "c", windows.owner(F.col("r"), h, 32, F.col("overlap")).alias("own_r"), windows.owner(F.col("c"), w, 32, F.col("overlap")).alias("own_c"))


@query(f"WITH {LABEL} SELECT r, c, code FROM lab WHERE code IN (1, 2)")
def class_positions(spark, sf_dir):
    return sample.class_positions(fixtures.labels(spark, sf_dir))


@query(f"WITH {LABEL}, {BALANCED} SELECT * FROM bal")
def balanced_samples(spark, sf_dir):
    return sample.balanced(fixtures.labels(spark, sf_dir), fixtures.LABEL_WIDTH)


@query(f"WITH {LABEL}, {BALANCED}, {KEPT} SELECT * FROM kept")
def patch_keep(spark, sf_dir):
    labels = fixtures.labels(spark, sf_dir)
    return sample.contained(sample.balanced(labels, fixtures.LABEL_WIDTH), *_size(labels), BLOCK, CROP)


SPLIT = f"SELECT r, c, code, CASE WHEN rn < floor(n * 0.6::DOUBLE) THEN 'train' WHEN rn < floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END split FROM (SELECT r, c, code, row_number() OVER (PARTITION BY code ORDER BY {KEY}, r, c) - 1 rn, count(*) OVER (PARTITION BY code) n FROM kept)"


@query(f"WITH {LABEL}, {BALANCED}, {KEPT} {SPLIT}")
def stratified_split(spark, sf_dir):
    labels = fixtures.labels(spark, sf_dir)
    return prepare.samples(labels, *_size(labels), BLOCK, CROP)


@query(f"WITH {LABEL}, {BALANCED}, {KEPT} SELECT k.r patch_r, k.c patch_c, count(*) n, sum(l.code * ((l.r - k.r + 4) * 8 + (l.c - k.c + 4))) checksum FROM kept k JOIN lab l ON l.r BETWEEN k.r - 4 AND k.r + 3 AND l.c BETWEEN k.c - 4 AND k.c + 3 GROUP BY k.r, k.c")
def patch_slices(spark, sf_dir):
    labels = fixtures.labels(spark, sf_dir)
    kept = sample.contained(sample.balanced(labels, fixtures.LABEL_WIDTH), *_size(labels), BLOCK, CROP)
    codes = tiles.from_cells(labels, ["code"], *_size(labels), 16)
    d = sample.patch_arrays(kept.select("r", "c"), codes, ["code"], CROP, 16)
    checksum = F.aggregate(F.transform("code", lambda x, i: x.cast("long") * i), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("patch_r", "patch_c", F.size("code").cast("long").alias("n"), checksum.cast("decimal(38,0)").alias("checksum"))


@query("SELECT d.doc_id, d.source, l.quality, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END target FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def patch_pairs(spark, sf_dir):
    """Documents and labels as the two sides of patches, of which those with both are paired."""
    side = lambda name, *more: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.lit("train").alias("split"), (F.col("doc_id") % 2).cast("string").alias("cls"), F.col("doc_id").alias("r"), F.lit(0).alias("c"), *more)
    d = patches.pair(side("documents", "source"), side("labels", "quality"))
    return d.select(F.col("r").alias("doc_id"), "source", "quality", F.when(F.col("quality") == 1, 1).otherwise(0).alias("target"))


@query(f"WITH {WRITES} SELECT * FROM runs")
def overlap_resolve(spark, sf_dir):
    return windows.last_writer(fixtures.writes(spark, sf_dir), ["run", "px"], "p", ["l_partkey", "l_suppkey", "l_extendedprice"])


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_resolve(spark, sf_dir)


@query(f"WITH {WRITES} SELECT o_orderkey px, CASE WHEN o_orderstatus <> 'F' THEN p END p FROM orders LEFT JOIN (SELECT px, p FROM runs WHERE run = 1) ON px = o_orderkey")
def mask_apply(spark, sf_dir):
    mask = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("px"), (F.col("o_orderstatus") != "F").alias("on"))
    return mosaic.masked(_runs(spark, sf_dir).where("run = 1").select("px", "p"), mask, ["px"], "p")


@query(f"WITH {WRITES} SELECT px, median(p) p FROM runs WHERE px IN (SELECT px FROM runs WHERE run = 1) GROUP BY px")
def median_mosaic(spark, sf_dir):
    runs = staged(_runs(spark, sf_dir), "runs")
    return mosaic.median_mosaic(runs, ["px"], "p", runs.where("run = 1"))


@query(f"WITH {WRITES}, med AS (SELECT px, median(p) p FROM runs GROUP BY px), bins AS (SELECT * FROM (VALUES (0, 'Very Low'), (1, 'Low'), (2, 'Medium'), (3, 'High'), (4, 'Very High')) t(bin, risk_level)), n AS (SELECT CASE WHEN p < 0 THEN NULL WHEN p < 0.2::DOUBLE THEN 0 WHEN p < 0.4::DOUBLE THEN 1 WHEN p < 0.6::DOUBLE THEN 2 WHEN p < 0.8::DOUBLE THEN 3 WHEN p <= 1 THEN 4 END bin, count(*) k FROM med GROUP BY 1) SELECT bins.bin, risk_level, coalesce(k, 0) pixel_count, round(coalesce(k, 0) / (SELECT sum(k) FROM n) * 100, 6) percentage FROM bins LEFT JOIN n ON n.bin = bins.bin")
def risk_histogram(spark, sf_dir):
    maps = mosaic.median_mosaic(_runs(spark, sf_dir), ["px"])
    return mosaic.risk_histogram(maps).withColumn("percentage", F.round("percentage", 6))


@query(f"WITH {PRED}, k AS (SELECT g, count(*) n, count(*) FILTER (y = 1 AND pred = 1) tp, count(*) FILTER (y = 0 AND pred = 1) fp, count(*) FILTER (y = 1 AND pred = 0) fn, count(*) FILTER (y = 0 AND pred = 0) tn FROM pr WHERE y <> -1 GROUP BY g) SELECT *, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS \"precision\", round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) f1, round((tp + tn) / n::DOUBLE, 6) accuracy FROM k")
def binary_metrics(spark, sf_dir):
    d = metrics.binary_metrics(fixtures.predictions(spark, sf_dir), ["g"])
    return d.select("g", "n", "tp", "fp", "fn", "tn", *[_r(c) for c in ("precision", "recall", "f1", "accuracy")])


P1 = "0.05::DOUBLE + (doc_id * 37 % 90) / 100::DOUBLE"


@query(f"WITH {PRED}, b AS (SELECT doc_id // 64 batch, avg(-ln(CASE WHEN y = 1 THEN {P1} WHEN y = 0 THEN 1 - ({P1}) END)) loss FROM pr GROUP BY 1) SELECT CAST(batch AS BIGINT) batch, round(loss, 6) loss, (SELECT round(avg(loss), 6) FROM b WHERE loss IS NOT NULL) epoch_loss FROM b WHERE loss IS NOT NULL")
def masked_cross_entropy(spark, sf_dir):
    rows = fixtures.predictions(spark, sf_dir).withColumn("p1", F.lit(0.05) + (F.col("doc_id") * 37 % 90) / F.lit(100.0))
    losses = staged(metrics.batch_losses(metrics.batched(rows, "doc_id", 64)).where(~F.isnan("loss")), "losses")
    return losses.join(F.broadcast(metrics.epoch_loss(losses).select(F.col("loss").alias("epoch_loss")))).select("batch", _r("loss"), _r("epoch_loss"))


LOG = f"{PRED}, lg AS (SELECT CAST(substr(g, 4) AS INT) + 1 epoch, round(coalesce(2 * count(*) FILTER (y = 1 AND pred = 1) / nullif(2 * count(*) FILTER (y = 1 AND pred = 1) + count(*) FILTER (y = 0 AND pred = 1) + count(*) FILTER (y = 1 AND pred = 0), 0)::DOUBLE, 0), 6) f1 FROM pr WHERE y <> -1 GROUP BY g)"


@query(f"WITH {LOG}, a AS (SELECT epoch, f1, f1 > coalesce(max(f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) improved FROM lg), b AS (SELECT *, coalesce(max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch), 0) best_epoch FROM a), d AS (SELECT *, epoch - best_epoch wait FROM b) SELECT * FROM d WHERE epoch <= coalesce((SELECT min(epoch) FROM d WHERE wait >= 4), 1000000)")
def best_epoch(spark, sf_dir):
    log = metrics.binary_metrics(fixtures.predictions(spark, sf_dir), ["g"]).select((F.substring("g", 4, 9).cast("int") + 1).alias("epoch"), _r("f1"))
    return metrics.best_epoch(log, patience=4)


@query(f"WITH {FACTOR}, {W_SQL} SELECT r, c, round(1 / (1 + exp(0.125::DOUBLE - sum(v * wt))), 6) p FROM clean JOIN w ON w.band = clean.band GROUP BY r, c")
def linear_score(spark, sf_dir):
    return predict.pixel_local(fixtures.factors(spark, sf_dir), WEIGHTS, BIAS).select("r", "c", _r("p"))


def _linear_windows():
    import numpy as np

    weights = np.array(WEIGHTS)
    return lambda x: 1 / (1 + np.exp(-(np.tensordot(weights, x.astype(float), 1) + BIAS)))


@query(f"WITH {FACTOR}, {W_SQL}, s AS (SELECT r, c, 1 / (1 + exp(0.125::DOUBLE - sum(v * wt))) p FROM clean JOIN w ON w.band = clean.band GROUP BY r, c), ov AS (SELECT unnest([2, 3]) overlap) SELECT overlap, r, c, round(p, 4) p FROM s, ov, (SELECT max(r) + 1 h, max(c) + 1 w FROM s) WHERE h > overlap AND w > overlap")
def window_scores(spark, sf_dir):
    factors = fixtures.factors(spark, sf_dir)
    h, w = _size(factors)
    out = predict.windowed(score.band_stack(factors), h, w, 8, [2, 3], _linear_windows, 20, precision="double")
    return out.select("overlap", "r", "c", _r("p", 4))


@query(f"WITH {FACTOR}, {W_SQL}, bg AS (SELECT band, avg(v) m FROM clean WHERE r < 4 GROUP BY band) SELECT r, c, clean.band, v x, round(wt * (v - m), 6) phi FROM clean JOIN w ON w.band = clean.band JOIN bg ON bg.band = clean.band")
def linear_attribution(spark, sf_dir):
    return _attr(spark, sf_dir).select("r", "c", "band", "x", _r("phi"))


def _attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attrib.linear_attribution(_clean(spark, sf_dir), WEIGHTS, F.col("r") < 4)


ATTR = f"{FACTOR}, {W_SQL}, bg AS (SELECT band, avg(v) m FROM clean WHERE r < 4 GROUP BY band), attr AS (SELECT r, c, clean.band, v x, wt * (v - m) phi FROM clean JOIN w ON w.band = clean.band JOIN bg ON bg.band = clean.band), imp AS (SELECT band, avg(abs(phi)) mean_abs FROM attr GROUP BY band), rk AS (SELECT band, mean_abs, mean_abs / sum(mean_abs) OVER () importance, row_number() OVER (ORDER BY mean_abs DESC, band DESC) rank FROM imp)"
STEMS_SQL = ", ".join(f"'{n}'" for n in fixtures.STEMS)
FILES = f"files AS (SELECT DISTINCT CASE WHEN p_size % 5 < 2 THEN '' ELSE 'dir' || (p_size % 5) END dir, coalesce([{STEMS_SQL}][CAST(substr(p_brand, 7) AS INT) % 12 + 1], 'f' || (CAST(substr(p_brand, 7) AS INT) % 12)) || CASE WHEN p_partkey % 3 = 0 THEN '.tiff' ELSE '.tif' END AS name FROM part)"
NAMES_SQL = ", ".join(f"('{k}', '{v}')" for k, v in attrib.FACTOR_NAMES.items())
CATS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in attrib.FACTOR_CATEGORIES.items())
NAMED = f"{FILES}, names AS (SELECT * FROM (VALUES {NAMES_SQL}) t(file, name)), cats AS (SELECT * FROM (VALUES {CATS_SQL}) t(name, category)), tif AS (SELECT row_number() OVER (ORDER BY name) - 1 band, replace(name, '.tif', '') raw FROM files WHERE dir = '' AND name LIKE '%.tif'), named AS (SELECT CAST(b AS INT) band, coalesce((SELECT name FROM names WHERE lower(file) = lower(raw)), (SELECT min(name) FROM names WHERE translate(lower(file), '_ ', '') = translate(lower(raw), '_ ', '')), raw, 'Band_' || (b + 1)) AS name FROM range(0, 20) t(b) LEFT JOIN tif ON tif.band = b)"


@query(f"WITH {NAMED} SELECT * FROM named")
def factor_names(spark, sf_dir):
    return _named(spark, sf_dir)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attrib.factor_names(catalog.raw_names(fixtures.files(spark, sf_dir)), 20)


@query(f"WITH {ATTR}, {NAMED} SELECT rk.band, named.name, coalesce(category, 'Unknown') category, round(importance, 6) importance, rank FROM rk JOIN named ON named.band = rk.band LEFT JOIN cats ON cats.name = named.name")
def global_importance(spark, sf_dir):
    ranked = attrib.importance(_attr(spark, sf_dir))
    d = attrib.with_category(ranked.join(F.broadcast(_named(spark, sf_dir)), "band"))
    return d.select("band", "name", "category", _r("importance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {ATTR} SELECT rank, attr.band, r, c, x, round(phi, 6) phi FROM attr JOIN rk ON rk.band = attr.band WHERE rank <= 2")
def dependence_top2(spark, sf_dir):
    attr = staged(_attr(spark, sf_dir), "attr")
    d = attrib.dependence(attr, attrib.importance(attr))
    return d.select(F.col("rank").cast("long").alias("rank"), "band", "r", "c", "x", _r("phi"))


@query(f"WITH {ATTR} SELECT band, x, round(phi, 6) phi, row_number() OVER (ORDER BY abs(phi), band) step, round(sum(phi) OVER (ORDER BY abs(phi), band ROWS UNBOUNDED PRECEDING), 6) path FROM attr WHERE r = 7 AND c = 5")
def waterfall(spark, sf_dir):
    d = attrib.decision_path(_attr(spark, sf_dir), 7, 5)
    return d.select("band", "x", _r("phi"), F.col("step").cast("long").alias("step"), _r("path"))


@query(f"WITH {ATTR} SELECT round(max(abs(phi)), 6) AS \"limit\" FROM attr")
def effect_limit(spark, sf_dir):
    return attrib.effect_limit(_attr(spark, sf_dir)).select(_r("limit"))


@query(f"WITH {LABEL}, s AS (SELECT r // 4 + 1 batch, r % 4 pos, max(CASE WHEN code = 1 AND c BETWEEN 48 AND 51 THEN 1 ELSE 0 END) has FROM lab GROUP BY 1, 2) SELECT CAST(coalesce(arg_min(batch, (batch, pos)), 1) AS BIGINT) batch, CAST(coalesce(arg_min(pos, (batch, pos)), 0) AS BIGINT) pos, count(*) > 0 found FROM s WHERE has = 1 AND batch BETWEEN 2 AND 16")
def first_slide_sample(spark, sf_dir):
    labels = fixtures.labels(spark, sf_dir)
    seen = F.max(F.when((F.col("code") == 1) & F.col("c").between(48, 51), True).otherwise(False))
    s = labels.groupBy((F.floor(F.col("r") / 4) + 1).alias("batch"), (F.col("r") % 4).alias("pos")).agg(seen.alias("has_slide"))
    return attrib.first_slide_sample(s)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bands of each pixel and a target that a linear scorer can learn; rows of even r train."""
    d = score.band_stack(_clean(spark, sf_dir)).withColumn("y", (F.get("f", F.lit(0)) + F.get("f", F.lit(1)) > 1).cast("int"))
    return d.where("r % 2 = 0"), d.where("r % 2 = 1")


def trained_scorer(spark, sf_dir):
    """Training log of the linear scorer, and its held-out metrics in the last row (epoch 0)."""
    fit, held = _split(spark, sf_dir)
    found = train.fit_linear(fit, held, 20, epochs=12, rate=0.1, patience=5)
    log = spark.createDataFrame(found.log, "epoch int, loss double, f1 double, rate double")
    return log.unionByName(train.evaluate_linear(held, found).select(F.lit(0).alias("epoch"), F.lit(None).cast("double").alias("loss"), "f1", F.lit(None).cast("double").alias("rate")))


def network_scores(spark, sf_dir):
    """Windows of the elevation and a second band scored by the network with fixed small weights: overlap, r, c, p."""
    dem = fixtures.dem(spark, sf_dir)
    pixels = dem.select("r", "c", F.array(F.coalesce(F.col("z") / 100, F.lit(0.0)), F.col("c") / F.lit(40.0)).alias("f"))
    h, w = _size(dem)

    def load():
        p = network.fresh(2, 1, (8, 16, 16, 16), 8)
        return lambda x: network.probability(x, p)

    return predict.windowed(pixels, h, w, 16, [4], load, 2)


QUERIES |= {"trained_scorer": trained_scorer, "network_scores": network_scores}


@query("SELECT 'o' || o_orderkey AS name, k AS type, CASE WHEN k = 'int' AND o_custkey % 7 > 0 THEN CAST(o_custkey AS INT) END int_value, CASE WHEN k = 'float' AND o_custkey % 7 > 0 THEN o_custkey / 8::DOUBLE END float_value, CASE WHEN k = 'bool' THEN o_custkey % 7 > 3 END bool_value, CASE WHEN k = 'list' THEN CASE WHEN o_custkey % 7 > 0 THEN '0|' || o_custkey ELSE '' END END list_value, CASE WHEN k IS NULL THEN 'out' || o_custkey END string_value FROM (SELECT *, ['int', 'float', 'bool', 'list'][o_orderkey % 5 + 1] k FROM orders)")
def config_typed(spark, sf_dir):
    """Values that aren't of their type, empty lists, flags in any case, no type at all."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS position", "concat('o', o_orderkey) AS name", "get(array('int', 'float', 'bool', 'list'), CAST(o_orderkey % 5 AS INT)) AS type", "o_custkey AS v", "o_custkey % 7 AS m")
    text = "CASE type WHEN 'int' THEN IF(m > 0, concat(v, ' '), 'n/a') WHEN 'float' THEN IF(m > 0, CAST(v / 8D AS STRING), '') WHEN 'bool' THEN IF(m > 3, 'TRUE', 'no') WHEN 'list' THEN IF(m > 0, concat('[0, ', v, ']'), '[ ]') ELSE concat('out', v) END"
    d = config.typed(rows.withColumn("value", F.expr(text)))
    return d.withColumn("list_value", F.when(F.col("list_value").isNotNull(), F.array_join(F.transform("list_value", lambda x: x.cast("string")), "|")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_linenumber % 4 AS INT) n, CAST(CASE l_linenumber % 4 WHEN 1 THEN l_partkey WHEN 2 THEN l_partkey + l_suppkey WHEN 3 THEN l_partkey + l_suppkey + l_linenumber END AS INT) total FROM lineitem")
def str_to_list(spark, sf_dir):
    """Lists of none to three values; a single one may come without brackets."""
    text = "CASE l_linenumber % 4 WHEN 0 THEN '[]' WHEN 1 THEN IF(l_suppkey % 2 = 0, concat('[', l_partkey, ']'), CAST(l_partkey AS STRING)) WHEN 2 THEN concat('[', l_partkey, ',', l_suppkey, ']') ELSE concat('[ ', l_partkey, ', ', l_suppkey, ' , ', l_linenumber, ' ]') END"
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", int_list(F.expr(text)).alias("l"))
    total = F.aggregate("l", F.lit(0), lambda a, x: a + x)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("l").alias("n"), F.when(F.size("l") > 0, total).alias("total"))


@query("SELECT p_partkey, CASE WHEN starts_with(raw, 'module.') THEN substr(raw, 8) ELSE raw END layer FROM (SELECT p_partkey, ['', 'module.', 'stem.module.', 'module.module.'][p_partkey % 4 + 1] || replace(p_name, ' ', '.') raw FROM part)")
def module_prefix(spark, sf_dir):
    """The prefix goes once, and only from the beginning."""
    raw = F.expr("concat(get(array('', 'module.', 'stem.module.', 'module.module.'), CAST(p_partkey % 4 AS INT)), replace(p_name, ' ', '.'))")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", strip_module(raw).alias("layer"))


@query("SELECT CAST(row_number() OVER (ORDER BY dir) - 1 AS INT) band, dir, min(name) AS name FROM (SELECT CASE WHEN p_size % 7 = 0 THEN '' ELSE p_brand END dir, p_partkey || CASE WHEN p_size % 7 = 0 OR p_partkey % 3 = 0 THEN '.txt' WHEN p_partkey % 3 = 1 THEN '.TIF' ELSE '.tif' END AS name FROM part) WHERE dir <> '' AND name LIKE '%.tif' GROUP BY dir")
def factor_discovery(spark, sf_dir):
    """A root without rasters: the first raster of each directory; other files, and other cases of the extension, aren't rasters."""
    place, end = "IF(p_size % 7 = 0, '', p_brand) AS dir", "CASE WHEN p_size % 7 = 0 OR p_partkey % 3 = 0 THEN '.txt' WHEN p_partkey % 3 = 1 THEN '.TIF' ELSE '.tif' END"
    return catalog.factor_files(spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(place, f"concat(p_partkey, {end}) AS name"))


@query(f"WITH {FILES} SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INT) band, dir, name FROM files WHERE dir = '' AND name LIKE '%.tif'")
def factor_listing(spark, sf_dir):
    return catalog.factor_files(fixtures.files(spark, sf_dir), nested=False)


@query(f"WITH {FILES} SELECT CAST(row_number() OVER (ORDER BY dir) - 1 AS INT) band, dir, min(name) AS name FROM files WHERE dir <> '' AND name LIKE '%.tif' GROUP BY dir")
def nested_listing(spark, sf_dir):
    return catalog.factor_files(fixtures.files(spark, sf_dir).where("dir <> ''"))


@query(f"WITH {FILES} SELECT min(name) AS name FROM files WHERE name LIKE '%.tif'")
def label_discovery(spark, sf_dir):
    return catalog.label_file(fixtures.files(spark, sf_dir))


@query(f"WITH {FILES}, names AS (SELECT * FROM (VALUES {NAMES_SQL}) t(file, name)), tiff AS (SELECT row_number() OVER (ORDER BY name) - 1 band, replace(name, '.tiff', '') raw FROM files WHERE dir = '' AND name LIKE '%.tiff') SELECT CAST(b AS INT) band, coalesce((SELECT min(name) FROM names WHERE translate(lower(file), '_ ', '') = translate(lower(raw), '_ ', '')), raw, 'Band_' || (b + 1)) AS name FROM range(0, 20) t(b) LEFT JOIN tiff ON tiff.band = b")
def factor_names_tiff(spark, sf_dir):
    """Names from `.tiff` files, where the root has no `.tif`."""
    return attrib.factor_names(catalog.raw_names(fixtures.files(spark, sf_dir).where(F.col("name").endswith(".tiff"))), 20)


@query("SELECT CAST(i AS INT) position, (SELECT min_by(o_custkey, o_orderkey) FROM orders WHERE o_orderpriority = p) AS value FROM (VALUES (0, '5-LOW'), (1, '1-URGENT')) t(i, p)")
def config_projection(spark, sf_dir):
    """First matches in the order asked for; a missing name is left out."""
    params = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS position", "o_orderpriority AS name", "o_custkey AS value")
    found = config.projected(params, ["5-LOW", "absent", "1-URGENT"])
    return found.select((F.row_number().over(Window.orderBy("position")) - 1).cast("int").alias("position"), "value")  # a row for each name


@query("SELECT doc_id, CAST(doc_id * 7 % 11 < n_chars % 11 AS INT) pred FROM documents")
def hard_class(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", metrics.predicted(F.col("doc_id") * 7 % 11, F.col("n_chars") % 11).alias("pred"))


@query(f"WITH RECURSIVE {LOG}, o AS (SELECT epoch, f1, row_number() OVER (ORDER BY epoch) i FROM lg), st AS (SELECT 0::BIGINT i, 0::INT epoch, -1::DOUBLE best, 0::INT bad, 1e-4::DOUBLE rate UNION ALL SELECT i, epoch, CASE WHEN worse THEN best ELSE f1 END, CASE WHEN worse AND bad < 2 THEN bad + 1 ELSE 0 END, CASE WHEN worse AND bad >= 2 THEN greatest(rate / 2, 1e-6::DOUBLE) ELSE rate END FROM (SELECT o.i, o.epoch, o.f1, st.best, st.bad, st.rate, o.f1 <= CASE WHEN st.best > 0 THEN st.best * 1.0001::DOUBLE ELSE st.best END worse FROM st JOIN o ON o.i = st.i + 1)) SELECT epoch, rate FROM st WHERE i > 0")
def plateau_rates(spark, sf_dir):
    log = metrics.binary_metrics(fixtures.predictions(spark, sf_dir), ["g"]).select((F.substring("g", 4, 9).cast("int") + 1).alias("epoch"), _r("f1"))
    return metrics.learning_rates(log, patience=2)


RUNS = f"{PRED}, lg AS (SELECT CAST(doc_id % 3 AS INT) run, CAST(substr(g, 4) AS INT) + 1 epoch, round(coalesce(2 * count(*) FILTER (y = 1 AND pred = 1) / nullif(2 * count(*) FILTER (y = 1 AND pred = 1) + count(*) FILTER (y = 0 AND pred = 1) + count(*) FILTER (y = 1 AND pred = 0), 0)::DOUBLE, 0), 6) f1 FROM pr WHERE y <> -1 GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {RUNS}, o AS (SELECT run, epoch, f1, row_number() OVER (PARTITION BY run ORDER BY epoch) i FROM lg), st AS (SELECT DISTINCT run, 0::BIGINT i, 0::INT epoch, -1::DOUBLE best, 0::INT bad, 1e-4::DOUBLE rate FROM lg UNION ALL SELECT run, i, epoch, CASE WHEN worse THEN best ELSE f1 END, CASE WHEN worse AND bad < 1 THEN bad + 1 ELSE 0 END, CASE WHEN worse AND bad >= 1 THEN greatest(rate / 2, 1e-6::DOUBLE) ELSE rate END FROM (SELECT o.run, o.i, o.epoch, o.f1, st.best, st.bad, st.rate, o.f1 <= CASE WHEN st.best > 0 THEN st.best * 1.0001::DOUBLE ELSE st.best END worse FROM st JOIN o ON o.run = st.run AND o.i = st.i + 1)) SELECT run, epoch, rate FROM st WHERE i > 0")
def plateau_runs(spark, sf_dir):
    """The schedule of several runs' logs in one job."""
    rows = fixtures.predictions(spark, sf_dir).withColumn("run", (F.col("doc_id") % 3).cast("int"))
    log = metrics.binary_metrics(rows, ["run", "g"]).select("run", (F.substring("g", 4, 9).cast("int") + 1).alias("epoch"), _r("f1"))
    return metrics.learning_rates(log, patience=1, by=["run"])


PERMUTED = "list_reduce(list_prepend(i, range(16)), lambda x, r: CASE WHEN (greatest(x, (((5 * 7919 + 3 * 104729 + r * 613) * 7919 % 65537 * 65543 % n - x) % n + n) % n) % 65537 * 7919 + (5 * 104729 + 3 * 7919 + r * 977) % 65537) % 65537 % 2 = 1 THEN (((5 * 7919 + 3 * 104729 + r * 613) * 7919 % 65537 * 65543 % n - x) % n + n) % n ELSE x END)"


@query(f"SELECT doc_id, CAST(place AS BIGINT) place, CAST(place // 16 AS BIGINT) batch FROM (SELECT doc_id, n, {PERMUTED} place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 i, count(*) OVER () n FROM documents)) WHERE place // 16 < n // 16")
def epoch_batches(spark, sf_dir):
    """Batches of the third epoch: its own order, the incomplete last batch dropped."""
    rows = staged(loader.indexed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id"), "indexed")
    return loader.batches(rows, rows.count(), 16, epoch=3, seed=5, drop_last=True).select("doc_id", "place", "batch")


@query(f"WITH {PRED}, k AS (SELECT CAST(epoch AS INT) epoch, count(*) n, count(*) FILTER (y = 1 AND pred = 1) tp, count(*) FILTER (y = 0 AND pred = 1) fp, count(*) FILTER (y = 1 AND pred = 0) fn, count(*) FILTER (y = 0 AND pred = 0) tn FROM pr, range(1, 4) t(epoch) WHERE y <> -1 AND doc_id % epoch = 0 GROUP BY 1) SELECT epoch, n, tp, fp, fn, tn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) f1, round((tp + tn) / n::DOUBLE, 6) accuracy FROM k")
def metrics_log(spark, sf_dir):
    """Metrics that are observed while predictions are written, as the log table has them."""
    out = new_folder(spark, "log")
    for epoch in (1, 2, 3):
        rows, seen = metrics.observed(fixtures.predictions(spark, sf_dir).where(F.col("doc_id") % epoch == 0))
        rows.write.parquet(f"{out}/predictions-{epoch}")
        metrics.append_log(spark, f"{out}/log", "test", epoch, seen)
    return spark.read.parquet(f"{out}/log").select("epoch", "n", "tp", "fp", "fn", "tn", _r("f1"), _r("accuracy"))


@query(f"WITH RECURSIVE {DEM}, {NEAR}, {FILLED}, {SLOPE}, {FLOW}, {UP}, {JOINT}, b AS (SELECT p.r, p.c, acc, beta FROM acc JOIN ptrs p ON p.id = acc.id) SELECT psl.r, psl.c, CAST(acc AS DOUBLE) flow_acc, round(CAST(beta AS DOUBLE), 4) beta, round(coalesce(CAST(p AS DOUBLE), -9999::DOUBLE), 4) ps_l FROM psl JOIN b ON b.r = psl.r AND b.c = psl.c")
def morphometric_outputs(spark, sf_dir):
    """The rasters of a whole run, as they are read back."""
    out = new_folder(spark, "morphometric")
    morphometric.run(fixtures.dem(spark, sf_dir), out, morphometric.Settings(tile=TILE))
    read = lambda name: unbroadcast(rasters.read(spark, f"{out}/{name}").select("r", "c", F.col("v").cast("double").alias(name)))
    return read("ps_l").join(read("beta"), ["r", "c"]).join(read("flow_acc"), ["r", "c"]).select("r", "c", "flow_acc", _r("beta", 4), _r("ps_l", 4))


@query("SELECT 'v' || vec_id || '.weight' layer, CAST(len(embedding) AS INT) n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) total FROM embeddings")
def weights_table(spark, sf_dir):
    """Layers saved under a wrapper's names, read back under their own."""
    path = new_folder(spark, "weights")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    weights.save(rows.select(F.concat(F.lit("module.v"), "vec_id", F.lit(".weight")).alias("layer"), F.array(F.size("embedding")).alias("shape"), F.col("embedding").alias("v")), path)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return weights.table(spark, path).select("layer", F.get("shape", F.lit(0)).alias("n"), F.round(total, 4).alias("total"))


KINDS = "['int', 'float', 'bool', 'list', 'file']"


@query(f"SELECT 'p' || p_partkey AS name, k AS type, CASE WHEN k = 'int' THEN CAST(p_size AS INT) END int_value, CASE WHEN k = 'float' THEN p_size / 4::DOUBLE END float_value, CASE WHEN k = 'bool' THEN p_size % 2 = 0 END bool_value, CASE WHEN k = 'list' THEN CAST(p_size AS INT) + CAST(p_size + 1 AS INT) END list_sum, CASE WHEN k = 'file' THEN p_size || '.tif' END string_value FROM (SELECT *, {KINDS}[p_partkey % 5 + 1] k FROM part)")
def typed_parameters(spark, sf_dir):
    """Configuration rows of all types, lists among them."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS position", "concat('p', p_partkey) AS name", "element_at(array('int', 'float', 'bool', 'list', 'file'), CAST(p_partkey % 5 AS INT) + 1) AS type", "p_size")
    text = "CASE type WHEN 'int' THEN concat(' ', p_size) WHEN 'float' THEN CAST(p_size / 4D AS STRING) WHEN 'bool' THEN IF(p_size % 2 = 0, 'True', 'False') WHEN 'list' THEN concat('[', p_size, ', ', p_size + 1, ']') ELSE concat(p_size, '.tif') END"
    d = config.typed(rows.withColumn("value", F.expr(text)))
    total = F.when(F.col("list_value").isNotNull(), F.aggregate("list_value", F.lit(0), lambda a, x: a + x))
    return d.withColumn("list_sum", total).drop("list_value")


@query(f"WITH {FILES}, names AS (SELECT * FROM (VALUES {NAMES_SQL}) t(file, name)), cats AS (SELECT * FROM (VALUES {CATS_SQL}) t(name, category)) SELECT DISTINCT coalesce(category, 'Unknown') category FROM (SELECT coalesce((SELECT min(name) FROM names WHERE translate(lower(file), '_ ', '') = translate(lower(replace(files.name, '.tif', '')), '_ ', '')), replace(files.name, '.tif', '')) name FROM files WHERE dir = '' AND files.name LIKE '%.tif') x LEFT JOIN cats ON cats.name = x.name")
def listed_categories(spark, sf_dir):
    """Distinct categories of the factors that a listing has."""
    raw = catalog.raw_names(fixtures.files(spark, sf_dir))
    return attrib.with_category(attrib.factor_names(raw, raw.count())).select("category").distinct()


def _parameters(spark: SparkSession, **values: object) -> DataFrame:
    return spark.createDataFrame([(i, k, str(v)) for i, (k, v) in enumerate(values.items())], "position long, name string, value string")


def _splits(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    fit, held = (d.withColumn("key", F.col("r").cast("long") * 1000 + F.col("c")) for d in _split(spark, sf_dir))
    return {"train": fit, "val": held.where("c % 2 = 0"), "test": held.where("c % 2 = 1")}


def training_workflow(spark, sf_dir):
    """A training run by configuration: the log of its epochs, and the test's metrics in the last row (epoch 0)."""
    out = new_folder(spark, "run")
    params = _parameters(spark, train_output=out, num_epochs=6, lr=0.05, patience=4, batch_size=8, num_bands=20)
    tested = train.run(params, _splits(spark, sf_dir), workers=2)
    log = spark.read.parquet(f"{out}/log").select("epoch", "n", "f1", "loss")
    return log.unionByName(tested.select(F.lit(0).alias("epoch"), "n", "f1", F.lit(None).cast("double").alias("loss")))


@query(f"WITH {ATTR}, {FILES}, names AS (SELECT * FROM (VALUES {NAMES_SQL}) t(file, name)), cats AS (SELECT * FROM (VALUES {CATS_SQL}) t(name, category)), tif AS (SELECT row_number() OVER (ORDER BY name) - 1 band, replace(name, '.tif', '') raw FROM files WHERE dir = '' AND name LIKE '%.tif'), named AS (SELECT CAST(b AS INT) band, coalesce((SELECT min(name) FROM names WHERE translate(lower(file), '_ ', '') = translate(lower(raw), '_ ', '')), raw, 'Band_' || (b + 1)) AS name FROM range(0, 20) t(b) LEFT JOIN tif ON tif.band = b) SELECT CAST(rank AS VARCHAR) rank, named.name AS factor, coalesce(category, 'Unknown') category, printf('%.6f', importance) AS importance FROM rk JOIN named ON named.band = rk.band LEFT JOIN cats ON cats.name = named.name")
def attribution_workflow(spark, sf_dir):
    """Saved weights, factors and their listing to the importance report."""
    import numpy as np

    out = new_folder(spark, "explained")
    weights.write(spark, {"linear.weight": np.array([WEIGHTS]), "linear.bias": np.array([BIAS])}, f"{out}/model/best")
    explain.run(_parameters(spark, train_output=f"{out}/model", num_bands=20), fixtures.factors(spark, sf_dir), fixtures.files(spark, sf_dir), F.col("r") < 4, out, (7, 5), 8)
    return spark.read.option("header", True).csv(f"{out}/importance_csv").toDF("rank", "factor", "category", "importance")


@query(f"WITH {DEM} SELECT r, c, z FROM dem WHERE r >= 3 AND r < 11 AND c >= 20 AND c <= 60")
def tile_files(spark, sf_dir):
    """A window of a raster in tile files; tiles outside it aren't read."""
    path, dem = new_folder(spark, "tile-files"), fixtures.dem(spark, sf_dir)
    h, w = _size(dem)
    tilefiles.write(tiles.from_cells(dem, ["z"], h, w, 32), "z", path, h, w, 32)
    window = tilefiles.read(spark, path).where("r >= 3 and r < 11 and c >= 20 and c <= 60")
    return window.select("r", "c", F.col("v").cast("double").alias("z"))


QUERIES |= {"training_workflow": training_workflow}


@query(f"WITH {LABEL}, {BALANCED}, {KEPT}, sp AS ({SPLIT}) SELECT k.r, k.c, CASE WHEN any_value(k.code) = 1 THEN '1' ELSE '0' END cls, CAST(band AS INT) band, sum(((l.r * 7 + l.c * (band + 1)) % 9) / 8::DOUBLE * ((l.r - k.r + 4) * 8 + l.c - k.c + 5)) factor_sum, CAST(sum(CASE l.code WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END * ((l.r - k.r + 4) * 8 + l.c - k.c + 5)) AS BIGINT) target_sum FROM sp k JOIN lab l ON l.r BETWEEN k.r - 4 AND k.r + 3 AND l.c BETWEEN k.c - 4 AND k.c + 3, range(0, 2) t(band) WHERE k.split = 'train' GROUP BY k.r, k.c, band")
def patch_dataset(spark, sf_dir):
    """Labels and factors to written patches, and the training pairs read back with their targets."""
    labels = fixtures.labels(spark, sf_dir)
    factors = labels.select("r", "c", F.explode(F.array(F.lit(0), F.lit(1))).alias("band")).withColumn("v", (F.col("r") * 7 + F.col("c") * (F.col("band") + 1)) % 9 / F.lit(8.0))
    out = new_folder(spark, "patches")
    prepare.write_patches(labels, factors, *_size(labels), out, BLOCK, CROP)
    weighted = lambda a, t: F.aggregate(F.transform(a, lambda x, i: x.cast(t) * (i + 1)), F.lit(0).cast(t), lambda s, x: s + x)
    d = patches.read(spark, f"{out}/factors", f"{out}/labels", "train")
    return d.select("r", "c", F.col("cls").cast("string").alias("cls"), "band", weighted("pixels", "double").alias("factor_sum"), weighted("label", "long").alias("target_sum"))


@query(f"WITH {LABEL} SELECT r, c, CAST(r % 16 AS INT) dr, CAST(c % 16 AS INT) dc FROM lab WHERE r % 16 BETWEEN 4 AND 11 AND c % 16 BETWEEN 4 AND 11")
def centre_crop(spark, sf_dir):
    pixels = fixtures.labels(spark, sf_dir).select("r", "c", (F.col("r") % 16).alias("dr"), (F.col("c") % 16).alias("dc"))
    return attrib.center_crop(pixels, 16, 16, 8)


@query(f"WITH {ATTR}, px AS (SELECT DISTINCT r, c FROM attr), top AS (SELECT r, c FROM px ORDER BY ((CAST(r AS BIGINT) * 100045 + c) * 7919 + 104729) % 65537, r, c LIMIT 200) SELECT r, c, band, x, round(phi * 10000, 3) phi FROM attr JOIN top USING (r, c)")
def display_sample(spark, sf_dir):
    return attrib.display_sample(_attr(spark, sf_dir)).select("r", "c", "band", "x", _r("phi", 3))


@query(f"WITH {ATTR}, {NAMED}, legend AS (SELECT CAST(row_number() OVER (ORDER BY category) - 1 AS INT) AS position, category FROM (SELECT DISTINCT category FROM cats)), part_of AS (SELECT category, count(*) n, sum(importance) i FROM rk JOIN named ON named.band = rk.band JOIN cats ON cats.name = named.name GROUP BY category) SELECT position, legend.category, coalesce(n, 0) n_factors, round(coalesce(i, 0), 6) importance FROM legend LEFT JOIN part_of ON part_of.category = legend.category")
def factor_categories(spark, sf_dir):
    """The legend's categories, and what part of the importance each one's factors have."""
    named = attrib.with_category(attrib.importance(_attr(spark, sf_dir)).join(F.broadcast(_named(spark, sf_dir)), "band"))
    parts = named.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("importance").alias("i"))  # a row for each category
    legend = attrib.categories(spark).join(F.broadcast(parts), "category", "left")
    return legend.select("position", "category", F.coalesce("n", F.lit(0)).alias("n_factors"), F.round(F.coalesce("i", F.lit(0.0)), 6).alias("importance"))


@query(f"WITH {ATTR} SELECT band, r, c, round(phi, 6) phi, round(max(abs(phi)) OVER (), 6) AS \"limit\" FROM attr WHERE r BETWEEN 4 AND 11 AND c BETWEEN 3 AND 10")
def local_maps(spark, sf_dir):
    return attrib.local_maps(_attr(spark, sf_dir), 4, 3, 8).select("band", "r", "c", _r("phi"), _r("limit"))


@query(f"SELECT risk_level, CAST(pixel_count AS VARCHAR) pixel_count, printf('%.2f%%', percentage) AS percentage FROM ({ORACLES['risk_histogram']})")
def risk_report(spark, sf_dir):
    """The risk table as its file says it."""
    path = new_folder(spark, "risk")
    reports.risk_csv(mosaic.risk_histogram(mosaic.median_mosaic(_runs(spark, sf_dir), ["px"])), path)
    return spark.read.option("header", True).csv(path).toDF("risk_level", "pixel_count", "percentage")


@query(f"WITH {ATTR}, {NAMED} SELECT CAST(rank AS VARCHAR) rank, named.name AS factor, coalesce(category, 'Unknown') category, printf('%.6f', importance) AS importance FROM rk JOIN named ON named.band = rk.band LEFT JOIN cats ON cats.name = named.name")
def importance_report(spark, sf_dir):
    path = new_folder(spark, "importance")
    named = attrib.importance(_attr(spark, sf_dir)).join(F.broadcast(_named(spark, sf_dir)), "band")
    reports.importance_csv(attrib.with_category(named), path)
    return spark.read.option("header", True).csv(path).toDF("rank", "factor", "category", "importance")


@query(f"WITH {FACTOR}, {W_SQL}, s AS (SELECT 1 / (1 + exp(0.125::DOUBLE - sum(v * wt))) p FROM clean JOIN w ON w.band = clean.band GROUP BY r, c), n AS (SELECT least(CAST(floor(p * 5) AS INT), 4) bin, count(*) k FROM s GROUP BY 1) SELECT risk_level, CAST(coalesce(k, 0) AS VARCHAR) pixel_count, printf('%.2f%%', coalesce(k, 0) * 100::DOUBLE / (SELECT count(*) FROM s)) AS percentage FROM (VALUES (0, 'Very Low'), (1, 'Low'), (2, 'Medium'), (3, 'High'), (4, 'Very High')) t(b, risk_level) LEFT JOIN n ON bin = b")
def risk_workflow(spark, sf_dir):
    """Factors through overlapping windows, median raster and risk file: the whole prediction workflow."""
    out = new_folder(spark, "workflow")
    predict.run(fixtures.factors(spark, sf_dir), out, _linear_windows, 20, 8, [2, 3])
    return spark.read.option("header", True).csv(f"{out}/risk_csv").toDF("risk_level", "pixel_count", "percentage")


MASKED = "CASE WHEN clean.band = 0 AND (r + c) % 6 = 0 THEN 0::DOUBLE ELSE v END"


@query(f"WITH {FACTOR}, {W_SQL}, s AS (SELECT r, c, 1 / (1 + exp(0.125::DOUBLE - sum({MASKED} * wt))) p FROM clean JOIN w ON w.band = clean.band GROUP BY r, c), n AS (SELECT least(CAST(floor(p * 5) AS INT), 4) bin, count(*) k FROM s WHERE (r + c) % 6 <> 0 GROUP BY 1) SELECT risk_level, CAST(coalesce(k, 0) AS VARCHAR) pixel_count, printf('%.2f%%', coalesce(k, 0) * 100::DOUBLE / (SELECT sum(k) FROM n)) AS percentage FROM (VALUES (0, 'Very Low'), (1, 'Low'), (2, 'Medium'), (3, 'High'), (4, 'Very High')) t(b, risk_level) LEFT JOIN n ON bin = b")
def risk_workflow_masked(spark, sf_dir):
    """The prediction workflow where the first factor lacks data at every sixth pixel: these are in no map and no count."""
    out = new_folder(spark, "workflow")
    factors = fixtures.factors(spark, sf_dir)
    gone = (F.col("band") == 0) & ((F.col("r") + F.col("c")) % 6 == 0)
    predict.run(factors.withColumn("v", F.when(gone, F.lit(-9999.0)).otherwise(F.col("v"))), out, _linear_windows, 20, 8, [2, 3])
    return spark.read.option("header", True).csv(f"{out}/risk_csv").toDF("risk_level", "pixel_count", "percentage")
