"""Registered queries of the particle-table engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import optics as O
from ..operators import columns as C
from ..operators import filaments as L
from ..operators import grouping as G
from ..operators import joins as J
from ..operators import selection as S
from ..operators.ranking import numbered
from . import consistency, geometry, groups, maps, poses, tables
from .views import SEG, read, segments

QUERIES: dict = geometry.QUERIES | tables.QUERIES | groups.QUERIES | maps.QUERIES | poses.QUERIES | consistency.QUERIES
SQL: dict[str, str] = geometry.SQL | tables.SQL | groups.SQL | maps.SQL | poses.SQL | consistency.SQL


def _q(name: str, build, sql: str | None = None) -> None:
    """build: of segments; sql: over the view seg."""
    QUERIES[name] = lambda spark, sf_dir: build(segments(spark, sf_dir))
    if sql:
        SQL[name] = f"WITH RECURSIVE {SEG}{'' if sql.startswith(',') else ' '}{sql}"


def _t(name: str, build, sql: str | None = None) -> None:
    """build: of a reader of tables; sql: whole."""
    QUERIES[name] = lambda spark, sf_dir: build(lambda t: read(spark, sf_dir, t))
    if sql:
        SQL[name] = sql


def _r(column: str, digits: int = 4):
    return F.round(F.col(column), digits).alias(column)


# Columns
_q("add_parm", lambda d: C.add(d, "score", 2.5).select("rid", "score"), "SELECT rid, score + 2.5 AS score FROM seg")
_q("mult_parm", lambda d: C.multiply(d, "score", 3).select("rid", "score"), "SELECT rid, score * 3.0 AS score FROM seg")
_q("set_parm", lambda d: C.set_value(C.set_value(C.set_value(d, "a", "7"), "b", "1.5"), "c", "x1").select("rid", "a", "b", "c"), "SELECT rid, CAST(7 AS BIGINT) AS a, CAST(1.5 AS DOUBLE) AS b, 'x1' AS c FROM seg")
_q("duplicate_parm", lambda d: C.duplicate(d, {"score": "score2", "nothing": "n", "cls": "mic"}).select("rid", "score", "score2", "mic"), "SELECT rid, score, score AS score2, mic FROM seg")
_q("rename_parm", lambda d: C.rename(d.select("rid", "score", "cls"), {"score": "fom", "nothing": "n", "cls": "rid"}), "SELECT rid, score AS fom, cls FROM seg")
_q("del_parm", lambda d: C.delete(d.select("rid", "score", "cls"), "_score", "nothing"), "SELECT rid, cls FROM seg")
_q("keep_parm", lambda d: C.keep_only(d, "rid", "tube", "nothing"), "SELECT rid, tube FROM seg")
_q("replace_str", lambda d: C.replace_text(d, "image", "k_1", "[k].1").select("rid", "image"), "SELECT rid, replace(image, 'k_1', '[k].1') AS image FROM seg")
_q("replace_image_name", lambda d: d.select("rid", O.image_name(F.col("rid"), F.lit("new.mrcs")).alias("image")), "SELECT rid, printf('%06d@new.mrcs', rid) AS image FROM seg")
_q("image_name_parts", lambda d: d.select("rid", O.image_index(F.col("image")).alias("idx"), O.image_file(F.col("image")).alias("file")), "SELECT rid, CAST(split_part(image, '@', 1) AS BIGINT) AS idx, split_part(image, '@', 2) AS file FROM seg")
_q("change_pixel_size", lambda d: C.change_pixel_size(d, 2.0).select("rid", _r("defocus_u"), _r("defocus_v"), _r("cs"), "apix"), "SELECT rid, round(defocus_u * 1.6 * 1.6, 4) AS defocus_u, round(defocus_v * 1.6 * 1.6, 4) AS defocus_v, round(cs * 1.6 * 1.6 * 1.6 * 1.6, 4) AS cs, CAST(2.0 AS DOUBLE) AS apix FROM seg")
_q("astigmatism_convert", lambda d: d.select("rid", *[c.alias(n) for c, n in zip(O.defocus_to_mean(F.col("defocus_u"), F.col("defocus_v"), F.col("psi")), ("mean_um", "differ_um", "angle"))]), "SELECT rid, (defocus_u + defocus_v) / 2e4 AS mean_um, abs(defocus_u - defocus_v) / 1e4 AS differ_um, CASE WHEN defocus_u > defocus_v THEN psi % 180.0 ELSE (psi + 90.0) % 180.0 END AS angle FROM seg")
_q("astigmatism_back", lambda d: d.select("rid", *[c.alias(n) for c, n in zip(O.defocus_from_mean(F.col("x"), F.col("y"), F.col("psi")), ("u", "v", "angle"))]), "SELECT rid, x * 1e4 + y * 5e3 AS u, x * 1e4 - y * 5e3 AS v, psi AS angle FROM seg")
_q("psi_prior_180", lambda d: S.with_opposite(d.select("rid", "psi", "mic"), "psi", "mic"), "SELECT rid, psi, mic FROM seg UNION ALL SELECT rid, psi + 180, mic + (SELECT CAST(pow(10, ceil(log10(greatest(max(mic), 2)))) AS BIGINT) FROM seg) FROM seg")
_q("electron_wavelength", lambda d: d.select("rid", F.round(O.electron_wavelength(F.abs(F.col("score")) + 100), 8).alias("wavelength")), "SELECT rid, round(12.2639 / sqrt((abs(score) + 100) * 1000.0 + 0.97845e-6 * ((abs(score) + 100) * 1000.0) * ((abs(score) + 100) * 1000.0)), 8) AS wavelength FROM seg")
_q("filename_time_parse", lambda d: d.select("rid", O.acquisition_epoch(F.date_format(F.timestamp_micros((F.col("track") * 1000000).cast("long")), "'FoilHole_1_Data_2_46_'yyyyMMdd_HHmmss'_fractions.tiff'")).alias("epoch")), "SELECT rid, CAST(floor(track) AS BIGINT) AS epoch FROM seg")
_q("clean_micrograph", lambda d: d.select("rid", O.clean_micrograph(F.concat(F.lit("J1/motion/123456789012_"), F.col("tube"), F.lit("_patch_aligned_doseweighted.mrc"))).alias("name")), "SELECT rid, tube || '.mrc' AS name FROM seg")
# Angles
_q("angular_difference", lambda d: d.select("rid", F.round(A.angular_difference(F.col("psi"), F.col("rot")), 6).alias("differ")), "SELECT rid, round((((psi - rot + 180) % 360) + 360) % 360 - 180, 6) AS differ FROM seg")
_q("angle_range", lambda d: d.select("rid", F.round(A.angle_in_range(F.col("psi") * 3, -90, 90), 6).alias("angle")), "SELECT rid, round((((psi * 3 + 90) % 180) + 180) % 180 - 90, 6) AS angle FROM seg")
_q("twist2pitch", lambda d: d.select("rid", A.twist_to_pitch(F.col("psi"), F.lit(4.75)).alias("pitch")), "SELECT rid, CASE WHEN psi = 0 THEN 0.0 ELSE abs(360.0 / psi) * 4.75 END AS pitch FROM seg")
_HALF = "radians(rot) / 2 AS a, radians(tilt) / 2 AS b, radians(psi) / 2 AS c"
_q("euler_to_quaternion", lambda d: d.select("rid", *[F.round(c, 8).alias(n) for c, n in zip(A.euler_to_quaternion(F.col("rot"), F.col("tilt"), F.col("psi")), "wxyz")]), f"SELECT rid, round(cos(b) * cos(a + c), 8) AS w, round(sin(b) * sin(c - a), 8) AS x, round(sin(b) * cos(c - a), 8) AS y, round(cos(b) * sin(a + c), 8) AS z FROM (SELECT rid, {_HALF} FROM seg)")
_q("geodesic_distance", lambda d: d.select("rid", F.round(A.geodesic_distance(A.euler_to_quaternion(F.col("rot"), F.col("tilt"), F.col("psi")), (F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))), 4).alias("degrees")), f"SELECT rid, round(2 * degrees(acos(least(1.0, abs(cos(b) * cos(a + c))))), 4) AS degrees FROM (SELECT rid, {_HALF} FROM seg)")
# Filters
_q("select_in", lambda d: S.is_in(d, "cls", [2, 4]).select("rid", "cls"), "SELECT rid, cls FROM seg WHERE cls IN (2, 4)")
_q("select_value_range", lambda d: S.between_open(d, "score", 10, 50).select("rid", "score"), "SELECT rid, score FROM seg WHERE score > 10 AND score < 50")
_q("select_ratio_range", lambda d: S.ratio_range(d, "score", 0.25, 0.75).select("rid", "score"), ", r AS (SELECT *, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM seg) SELECT rid, score FROM r WHERE score >= (SELECT max(score) FROM r WHERE k = CAST(floor(n * 0.25) AS BIGINT)) AND score < (SELECT max(score) FROM r WHERE k = CAST(floor(n * 0.75) AS BIGINT) + 1)")
_q("first_last", lambda d: S.rows_between(d, "rid", 100, 400).select("rid"), "SELECT rid FROM seg WHERE rid >= 100 AND rid < 400")
_q("sets_stride", lambda d: S.stride(d, "rid", 3, 1).select("rid"), "SELECT rid FROM seg WHERE rid % 3 = 1")
_q("nan_drop", lambda d: d.withColumn("v", F.when(F.col("cls") == 2, F.lit(float("nan"))).when(F.col("cls") == 3, F.lit(None)).otherwise(F.col("score"))).where(F.col("v").isNotNull() & ~F.isnan("v")).select("rid", "v"), "SELECT rid, score AS v FROM seg WHERE cls NOT IN (2, 3)")
# Sorts
_q("sortby", lambda d: numbered(d.select("rid", "cls", "score"), ["cls", "score", "rid"], "place"), "SELECT rid, cls, score, CAST(row_number() OVER (ORDER BY cls, score, rid) AS INTEGER) AS place FROM seg")
_q("rsortby", lambda d: S.best_first(d.select("rid", "score"), "score", "rid", "place"), "SELECT rid, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, rid) AS INTEGER) AS place FROM seg")
_q("top_helices", lambda d: L.tube_lengths(d).orderBy(F.desc("span"), "mic", "tube").limit(20).select("mic", "tube", _r("span")), "SELECT mic, tube, round(max(track) - min(track), 4) AS span FROM seg GROUP BY mic, tube ORDER BY max(track) - min(track) DESC, mic, tube LIMIT 20")
# Duplicates, top-k, splits
_q("remove_duplicates", lambda d: S.first_of(d, ["mic", "cls"], "rid").select("rid", "mic", "cls"), "SELECT min(rid) AS rid, mic, cls FROM seg GROUP BY mic, cls")
_q("min_duplicates", lambda d: S.min_duplicates(d, "mic", 60, "rid").select("rid", "mic"), "SELECT min(rid) AS rid, mic FROM seg GROUP BY mic HAVING count(*) >= 60")
_q("keep_one_per_tube", lambda d: S.one_per_group(d.select("mic", "tube", "rid", "score", F.when(F.col("cls") > 2, F.col("cls")).alias("cls")), ["mic", "tube"], "rid"), "SELECT mic, tube, min(rid) AS rid, arg_min(score, rid) AS score, arg_min(cls, rid) FILTER (WHERE cls > 2) AS cls FROM seg GROUP BY mic, tube")
_q("keep_one_per_micrograph", lambda d: S.one_per_group(d.select("mic", "rid", "score"), ["mic"], "rid"), "SELECT mic, min(rid) AS rid, arg_min(score, rid) AS score FROM seg GROUP BY mic")
_q("norm_euler_topk", lambda d: S.best_per_bin(d.withColumn("bin_rot", F.floor(F.col("rot") / 30)).withColumn("bin_tilt", F.floor((1 - F.cos(F.radians("tilt"))) * 6)), ["bin_rot", "bin_tilt"], "score", 3, "rid").select("rid"), "SELECT rid FROM (SELECT rid, row_number() OVER (PARTITION BY floor(rot / 30), floor((1 - cos(radians(tilt))) * 6) ORDER BY score DESC NULLS LAST, rid) AS n FROM seg) WHERE n <= 3")
_q("random_sample", lambda d: S.random_sample(d, "tube", 25, "rid").select("rid", "tube"), "SELECT rid, tube FROM (SELECT rid, tube, row_number() OVER (PARTITION BY tube ORDER BY md5(CAST(rid AS VARCHAR) || ':1'), rid) AS n FROM seg) WHERE n <= 25")
_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(h, {k + 1}, 1)) - 1) * {16 ** (7 - k)}" for k in range(8))
_q("split_random", lambda d: S.split_random(d, "rid", 3).select("rid", "subset"), f", h AS (SELECT rid, md5(CAST(rid AS VARCHAR) || ':1') AS h FROM seg) SELECT rid, CAST(({_HEX}) % 3 + 1 AS INTEGER) AS subset FROM h")
_q("split_evenodd", lambda d: S.split_even_odd(d, "rid", 2).select("rid", "subset"), "SELECT rid, CAST(rid % 2 + 1 AS INTEGER) AS subset FROM seg")
_q("split_lpt", lambda d: S.split_largest_first(d, ["mic"], "rid", 2).select("rid", "subset"), """, g AS (SELECT mic, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(rid)) AS k FROM seg GROUP BY mic),
  p AS (SELECT k, mic, n AS a, 0::BIGINT AS b, 1 AS subset FROM g WHERE k = 1 UNION ALL SELECT g.k, g.mic, CASE WHEN p.a <= p.b THEN p.a + g.n ELSE p.a END, CASE WHEN p.a <= p.b THEN p.b ELSE p.b + g.n END, CASE WHEN p.a <= p.b THEN 1 ELSE 2 END FROM p JOIN g ON g.k = p.k + 1)
  SELECT rid, subset FROM seg JOIN p USING (mic)""")
_q("split_halves", lambda d: S.split_in_halves(d, ["mic"], "rid").select("rid", "mic", "subset"))
_q("blank_class_filter", lambda d: S.with_variation(d.select("rid", F.array("cls", F.lit(2).cast("long"), "cls").alias("image")), "image").select("rid"), "SELECT rid FROM seg WHERE cls <> 2")
_q("helix_class_filter", lambda d: S.with_any_class(d.groupBy("mic", "tube").agg(F.collect_set("cls").alias("classes")), "classes", [2, 5]).select("mic", "tube"), "SELECT DISTINCT mic, tube FROM seg WHERE cls IN (2, 5)")
# Groups
_q("per_micrograph_first_seen", lambda d: G.first_seen_ids(d, ["mic"], "rid", "grp").select("rid", "grp"), ", k AS (SELECT mic, row_number() OVER (ORDER BY min(rid)) AS grp FROM seg GROUP BY mic) SELECT rid, CAST(grp AS INTEGER) AS grp FROM seg JOIN k USING (mic)")
_q("set_beam_tilt_class", lambda d: G.first_seen_ids(d.withColumn("file", O.image_file(F.col("image"))), ["file"], "rid", "tilt_class").select("rid", "tilt_class"), ", k AS (SELECT split_part(image, '@', 2) AS file, row_number() OVER (ORDER BY min(rid)) AS tilt_class FROM seg GROUP BY 1) SELECT rid, CAST(tilt_class AS INTEGER) AS tilt_class FROM seg JOIN k ON k.file = split_part(image, '@', 2)")
_q("per_micrograph_sorted", lambda d: G.sorted_ids(d, ["mic"], "grp").select("rid", "grp"), "SELECT rid, CAST(dense_rank() OVER (ORDER BY mic) AS INTEGER) AS grp FROM seg")
_q("combine_groups", lambda d: G.sorted_ids(d, ["tube", "cls"], "grp").select("rid", "grp"), "SELECT rid, CAST(dense_rank() OVER (ORDER BY tube, cls) AS INTEGER) AS grp FROM seg")
_q("reset_groups", lambda d: G.reset(d, "grp").groupBy("grp").agg(F.count("*").alias("n")), "SELECT 1 AS grp, count(*) AS n FROM seg")
_q("sync_groups", lambda d: G.sync(d.select("rid", F.col("cls").alias("a_exp_group_id"), F.lit(0).cast("long").alias("b_exp_group_id")), "a_exp_group_id", "exp_group_id"), "SELECT rid, cls AS a_exp_group_id, cls AS b_exp_group_id FROM seg")
_q("beamshift_label_groups", lambda d: G.sorted_ids(d.withColumn("label", O.beam_shift_label(F.format_string("FoilHole_28788144_Data_28764755_%d_20240328_192116_f.tiff", F.col("cls") + 40)).cast("long")), ["tube", "label"], "grp").select("rid", "label", "grp"), "SELECT rid, cls + 40 AS label, CAST(dense_rank() OVER (ORDER BY tube, cls) AS INTEGER) AS grp FROM seg")
_q("time_groups", lambda d: G.time_groups(d, "tube", "track", 100, "grp").select("rid", "grp"), """, t AS (SELECT DISTINCT tube, track FROM seg), r AS (SELECT *, row_number() OVER (PARTITION BY tube ORDER BY track) AS k, count(*) OVER (PARTITION BY tube) AS n FROM t),
  g AS (SELECT tube, n, CASE WHEN n - (n - 1) // 100 * 100 < 50 AND (n - 1) // 100 > 0 THEN (n - 1) // 100 ELSE (n - 1) // 100 + 1 END AS groups FROM (SELECT DISTINCT tube, n FROM r)),
  o AS (SELECT *, coalesce(sum(groups) OVER (ORDER BY tube ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
  SELECT s.rid, CAST(least((k - 1) // 100, groups - 1) + before + 1 AS BIGINT) AS grp FROM seg s JOIN r USING (tube, track) JOIN o USING (tube)""")
_q("exposure_median_propagate", lambda d: G.propagate_medians(d.select("rid", "tube", "defocus_u", "score"), "tube", ["defocus_u", "score"]).select("rid", "tube", _r("defocus_u", 6), _r("score", 6)), ", m AS (SELECT tube, median(defocus_u) AS defocus_u, median(score) AS score FROM seg GROUP BY tube) SELECT rid, tube, round(m.defocus_u, 6) AS defocus_u, round(m.score, 6) AS score FROM seg JOIN m USING (tube)")
_q("build_optics", lambda d: G.build_optics(d.select("rid", "tube", "cls"), ["tube", "cls"], "rid")[0], ", k AS (SELECT tube, cls, row_number() OVER (ORDER BY min(rid)) AS g FROM seg GROUP BY tube, cls) SELECT rid, CAST(g AS INTEGER) AS optics_group FROM seg JOIN k USING (tube, cls)")
_q("dissolve_optics", lambda d: G.dissolve_optics(*G.build_optics(d.select("rid", "tube", "cls"), ["tube", "cls"], "rid")).select("rid", "tube", "cls"), "SELECT rid, tube, cls FROM seg")
# Joins
_t("select_file_semi", lambda t: J.semi(t("orders").withColumnRenamed("o_orderkey", "k"), t("lineitem").where("l_quantity > 45").withColumnRenamed("l_orderkey", "k"), ["k"]).select("k", "o_totalprice"), "SELECT o_orderkey AS k, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
_t("exclude_file_anti", lambda t: J.anti_or_all(t("orders").withColumnRenamed("o_orderkey", "k"), t("lineitem").where("l_quantity > 20").withColumnRenamed("l_orderkey", "k"), ["k"]).select("k"), "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)")
_q("select_common_helices", lambda d: J.semi(d, d.where("score > 60"), ["mic", "tube"]).select("rid"), "SELECT rid FROM seg WHERE (mic, tube) IN (SELECT (mic, tube) FROM seg WHERE score > 60)")
_q("copy_parm_keep_last", lambda d: J.last_lookup(d.select("rid", "mic", "score"), d.where("cls = 1").select("mic", "score", "rid"), "mic", ["score"], "rid"), ", k AS (SELECT mic, arg_max(score, rid) AS s FROM seg WHERE cls = 1 GROUP BY mic) SELECT rid, seg.mic, k.s AS score FROM seg LEFT JOIN k ON seg.mic = k.mic")
_q("copy_ctf_group_mean", lambda d: J.group_mean_lookup(d.select("rid", "mic", "defocus_u"), d.where("cls <> 3"), "mic", ["defocus_u"]).select("rid", "mic", _r("defocus_u")), ", k AS (SELECT mic, avg(defocus_u) AS m FROM seg WHERE cls <> 3 GROUP BY mic) SELECT rid, seg.mic, round(k.m, 4) AS defocus_u FROM seg LEFT JOIN k ON seg.mic = k.mic")
_q("select_by_location_range_join", lambda d: J.near_semi(d, d.select("mic", "rid", ((F.col("x") + 31) % 100).alias("x"), ((F.col("y") + 17) % 100).alias("y")), ["mic"], "x", "y", 2.0, "rid").select("rid"), ", o AS (SELECT mic, (x + 31) % 100 AS x, (y + 17) % 100 AS y FROM seg) SELECT rid FROM seg a WHERE EXISTS (SELECT 1 FROM o b WHERE a.mic = b.mic AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0)")
_q("select_by_location_all", lambda d: J.near_semi(d, d, ["mic"], "x", "y", 2.0, "rid", own=False).select("rid"), "SELECT rid FROM seg a WHERE EXISTS (SELECT 1 FROM seg b WHERE b.rid <> a.rid AND a.mic = b.mic AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0)")
_q("containment_join", lambda d: J.contained_in(d, "tube", d.sparkSession.createDataFrame([(1, "li", 1), (2, "e", 2)], "rank int, pattern string, value int"), "grp").select("rid", "grp"), "SELECT rid, CASE WHEN contains(tube, 'li') THEN 1 WHEN contains(tube, 'e') THEN 2 ELSE 0 END AS grp FROM seg")
_q("recover_full_filaments", lambda d: J.recover_filaments(d.where("score > 30"), d, ["mic", "tube"], 0.6).select("rid"), "SELECT rid FROM seg WHERE (mic, tube) IN (SELECT (mic, tube) FROM seg GROUP BY mic, tube HAVING count(*) FILTER (WHERE score > 30) / count(*) >= 0.6 AND count(*) FILTER (WHERE score > 30) > 0)")
# Filaments
_q("inter_segment_stats", lambda d: L.inter_segment_distance(d).select(_r("median_gap"), _r("mean_gap"), _r("std_gap")), ", g AS (SELECT track - lag(track) OVER (PARTITION BY mic, tube ORDER BY track, rid) AS gap FROM seg) SELECT round(median(gap), 4) AS median_gap, round(avg(gap), 4) AS mean_gap, round(stddev_pop(gap), 4) AS std_gap FROM g WHERE gap IS NOT NULL")
_q("tube_length", lambda d: L.tube_lengths(d).select("mic", "tube", _r("longest"), _r("span"), "segments"), "SELECT mic, tube, round(max(track), 4) AS longest, round(max(track) - min(track), 4) AS span, count(*) AS segments FROM seg GROUP BY mic, tube")
_q("break_filaments", lambda d: L.break_filaments(d, 5).select("rid", F.col("chunk_id").cast("long").alias("chunk_id")), ", c AS (SELECT rid, (row_number() OVER (PARTITION BY mic, tube ORDER BY track, rid) - 1) // 5 AS chunk, min(rid) OVER (PARTITION BY mic, tube) AS f FROM seg) SELECT rid, CAST(dense_rank() OVER (ORDER BY f, chunk) - 1 AS BIGINT) AS chunk_id FROM c")
_q("rebase_track", lambda d: L.rebased(d).select("rid", _r("track0")), "SELECT rid, round(track - min(track) OVER (PARTITION BY mic, tube), 4) AS track0 FROM seg")
_q("angle_variance_circular", lambda d: L.angle_variance(d).select("mic", "tube", _r("tilt_mean"), _r("tilt_std", 3), _r("psi_std", 3)), "SELECT mic, tube, round((degrees(atan2(avg(sin(radians(tilt))), avg(cos(radians(tilt))))) + 360) % 360, 4) AS tilt_mean, round(degrees(sqrt(-2 * ln(least(1.0, sqrt(pow(avg(sin(radians(tilt))), 2) + pow(avg(cos(radians(tilt))), 2)))))), 3) AS tilt_std, round(degrees(sqrt(-2 * ln(least(1.0, sqrt(pow(avg(sin(radians(2 * psi))), 2) + pow(avg(cos(radians(2 * psi))), 2)))))) / 2, 3) AS psi_std FROM seg GROUP BY mic, tube")
_q("angle_unwrap", lambda d: L.unwrapped(d).select("rid", _r("unwrapped")), ", s AS (SELECT *, (((rot - lag(rot) OVER w + 180) % 360) + 360) % 360 - 180 AS step, first_value(rot) OVER w AS f FROM seg WINDOW w AS (PARTITION BY mic, tube ORDER BY track, rid)) SELECT rid, round(f + sum(coalesce(step, 0)) OVER (PARTITION BY mic, tube ORDER BY track, rid ROWS UNBOUNDED PRECEDING), 4) AS unwrapped FROM s")
_GRID = """, t AS (SELECT mic, rid, track / 3600 AS x, CASE WHEN rot < 0 THEN rot + 360 ELSE rot END AS o, count(*) OVER (PARTITION BY mic) AS n FROM seg), k AS (SELECT k, CASE WHEN k = 1200 THEN 1.1 ELSE k * (2.2 / 1200) - 1.1 END AS m FROM range(1201) r(k)),
  r AS (SELECT mic, k, m, n, rid, x, o - m * x AS r FROM t, k WHERE n >= 25), j AS (SELECT *, floor((r - lag(r) OVER w) / 360 + 0.5) * 360 AS jump FROM r WINDOW w AS (PARTITION BY mic, k ORDER BY x, rid)),
  u AS (SELECT *, r - coalesce(sum(jump) OVER (PARTITION BY mic, k ORDER BY x, rid ROWS UNBOUNDED PRECEDING), 0) AS u FROM j), b AS (SELECT *, avg(u) OVER (PARTITION BY mic, k) AS b FROM u),
  f AS (SELECT mic, k, any_value(m) AS m, any_value(n) AS n, sum(pow(r - b - floor((r - b) / 360 + 0.5) * 360, 2)) AS sse FROM b GROUP BY mic, k), z AS (SELECT *, row_number() OVER (PARTITION BY mic ORDER BY round(sse, 3), k) AS place FROM f)"""
_hours = lambda d: d.withColumn("track", F.col("track") / 3600)
_q("hom_fit_best_slope", lambda d: L.fit_slopes(_hours(d), ["mic"]).select("mic", _r("slope", 6), _r("sse", 2), "segments"), f"{_GRID} SELECT mic, round(m, 6) AS slope, round(sse, 2) AS sse, n AS segments FROM z WHERE place = 1")
_q("hom_fit_all_slopes", lambda d: L.best_slope(_hours(d), ["mic"]).select("mic", _r("slope", 6), _r("variance", 3)), f"{_GRID} SELECT mic, round(m, 6) AS slope, round(sse / n, 3) AS variance FROM z WHERE place = 1")
_q("hom_consistency", lambda d: L.angular_consistency(L.rebased(d).withColumn("track", F.col("track0") / 3600), ["mic"], 0.25, 360.0 / 2).select("rid", _r("filament_slope", 6), _r("filament_error", 5), _r("segment_error", 5)),
   """, t AS (SELECT rid, mic, (track - min(track) OVER (PARTITION BY mic, tube)) / 3600 AS x, rot % 180 AS o, count(*) OVER (PARTITION BY mic) AS n FROM seg), r AS (SELECT *, o - 0.25 * x AS p, o + 0.25 * x AS q FROM t WHERE n >= 25),
  b AS (SELECT *, avg(((p % 180) + 180) % 180) OVER (PARTITION BY mic) AS bp, avg(((q % 180) + 180) % 180) OVER (PARTITION BY mic) AS bq FROM r), e AS (SELECT *, abs((((p - bp + 90) % 180) + 180) % 180 - 90) AS ep, abs((((q - bq + 90) % 180) + 180) % 180 - 90) AS eq FROM b),
  s AS (SELECT *, sum(ep) OVER (PARTITION BY mic) AS sp, sum(eq) OVER (PARTITION BY mic) AS sq FROM e) SELECT rid, CASE WHEN sp <= sq THEN 0.25::DOUBLE ELSE -0.25::DOUBLE END AS filament_slope, round(least(sp, sq) / n, 5) AS filament_error, round(CASE WHEN sp <= sq THEN ep ELSE eq END, 5) AS segment_error FROM s""")
_q("symmetry_guess", lambda d: d.sparkSession.range(1).select(F.lit(L.symmetry_guess(d)).alias("symmetry")), "SELECT CAST(greatest(2, floor(360.0 / (max(rot) - min(rot)) + 0.3)) AS INTEGER) AS symmetry FROM seg")
_q("l1_core", lambda d: L.l1_core(d, ["tube"], "score", 50).select("tube", _r("center", 6), _r("l1", 4)), """, o AS (SELECT tube, score, row_number() OVER (PARTITION BY tube ORDER BY score) AS i FROM seg), w AS (SELECT a.tube, a.i, median(b.score) AS c FROM o a JOIN o b ON a.tube = b.tube AND b.i BETWEEN a.i AND a.i + 49 GROUP BY a.tube, a.i HAVING count(*) = 50),
  d AS (SELECT w.tube, w.i, w.c, sum(abs(o.score - w.c)) AS l FROM w JOIN o ON w.tube = o.tube AND o.i BETWEEN w.i AND w.i + 49 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tube ORDER BY round(l, 6), c) AS n FROM d) SELECT tube, round(c, 6) AS center, round(l, 4) AS l1 FROM r WHERE n = 1""")
_PAIRS = ", p AS (SELECT a.mic, a.tube, a.cls, b.track - a.track AS distance FROM seg a JOIN seg b ON a.mic = b.mic AND a.tube = b.tube AND a.cls = b.cls AND a.track < b.track AND abs((((a.psi - b.psi + 180) % 360) + 360) % 360 - 180) < 90)"
_q("pair_distances", lambda d: L.pair_distances(d).select("mic", "tube", "cls", _r("distance")), f"{_PAIRS} SELECT mic, tube, cls, round(distance, 4) AS distance FROM p")
_q("pair_distance_histogram", lambda d: L.pair_distances(d).groupBy(F.floor(F.col("distance") / 86400).alias("bin")).agg(F.count("*").alias("n")).withColumn("twist", F.round(360.0 / ((F.col("bin") + 0.5) * 86400 / 4.75), 8)), f"{_PAIRS} SELECT CAST(floor(distance / 86400) AS BIGINT) AS bin, count(*) AS n, round(360.0 / ((floor(distance / 86400) + 0.5) * 86400 / 4.75), 8) AS twist FROM p GROUP BY floor(distance / 86400)")
_q("class_abundance", lambda d: d.sparkSession.range(1, 8).withColumnRenamed("id", "cls").join(d.groupBy("cls").agg(F.count("*").alias("n")), "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n")), "SELECT k AS cls, (SELECT count(*) FROM seg WHERE cls = k) AS n FROM range(1, 8) r(k)")
_q("helix_summary", lambda d: d.groupBy("mic", "tube", "cls").agg(F.count("*").alias("n"), (F.max("track")).alias("last")).groupBy("mic", "tube").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "cls"))), lambda s: s["cls"].cast("string")), " ").alias("classes"), F.round(F.max("last"), 4).alias("length")), ", c AS (SELECT mic, tube, cls, count(*) AS n, max(track) AS last FROM seg GROUP BY ALL) SELECT mic, tube, string_agg(CAST(cls AS VARCHAR), ' ' ORDER BY n DESC, cls) AS classes, round(max(last), 4) AS length FROM c GROUP BY mic, tube")
_q("helix_ordinal", lambda d: G.sorted_ids(d, ["mic", "tube"], "helix").select("rid", "helix"), "SELECT rid, CAST(dense_rank() OVER (ORDER BY mic, tube) AS INTEGER) AS helix FROM seg")
_LINES = """, e AS (SELECT mic, tube, avg(x) AS cx, avg(y) AS cy, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS t, arg_min(x, (track, rid)) AS ax, arg_min(y, (track, rid)) AS ay, arg_max(x, (track, rid)) AS bx, arg_max(y, (track, rid)) AS by_ FROM seg GROUP BY mic, tube),
  l AS (SELECT *, (bx - ax) * cos(t) + (by_ - ay) * sin(t) AS len, (ax - cx) * cos(t) + (ay - cy) * sin(t) AS start FROM e), k AS (SELECT *, unnest(range(CAST(floor(abs(len) / 25.0) AS BIGINT) + 1)) AS k FROM l)"""
_q("reset_inter_segment_distance", lambda d: L.resampled(d, 25.0).select("mic", "tube", "k", _r("x", 3), _r("y", 3)), f"""{_LINES}
  SELECT mic, tube, CAST(k AS INTEGER) AS k, round(cx + (start + CASE WHEN len < 0 THEN -1.0 ELSE 1.0 END * k * 25.0) * cos(t), 3) AS x, round(cy + (start + CASE WHEN len < 0 THEN -1.0 ELSE 1.0 END * k * 25.0) * sin(t), 3) AS y FROM k""")
_q("reset_inter_segment_rows", lambda d: L.resampled_rows(d, 2000.0).select("mic", "tube", "k", "rid", "cls", "track", _r("x", 3)), f"""{_LINES.replace('25.0', '2000.0')}, n AS (SELECT *, row_number() OVER (PARTITION BY mic, tube ORDER BY track, rid) - 1 AS n, count(*) OVER (PARTITION BY mic, tube) - 1 AS last FROM seg)
  SELECT k.mic, k.tube, CAST(k AS INTEGER) AS k, n.rid, n.cls, CAST(k * 2000 AS DOUBLE) AS track, round(cx + (start + CASE WHEN len < 0 THEN -1.0 ELSE 1.0 END * k * 2000.0) * cos(t), 3) AS x FROM k JOIN n ON n.mic = k.mic AND n.tube = k.tube AND n.n = least(k, n.last)""")
_q("banner_counts", lambda d: d.agg(F.countDistinct("mic").alias("mics"), F.countDistinct("mic", "tube").alias("helices"), F.count("*").alias("particles")), "SELECT count(DISTINCT mic) AS mics, count(DISTINCT (mic, tube)) AS helices, count(*) AS particles FROM seg")
_q("union_distinct", lambda d: d.where("cls < 4").unionByName(d.where("cls > 2")).dropDuplicates(["rid"]).select("rid"), "SELECT DISTINCT rid FROM (SELECT rid FROM seg WHERE cls < 4 UNION ALL SELECT rid FROM seg WHERE cls > 2)")
_t("cosine_similarity", lambda t: (lambda e: e.alias("a").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(A.cosine_similarity("embedding", "other"), 6).alias("cosine")))(t("embeddings")), "SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
