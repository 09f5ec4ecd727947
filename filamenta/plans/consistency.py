"""Registered queries of the chain of helical consistency and of qualities of filaments' angles, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consistency as K
from ..operators import filaments as L
from .views import SEG, segments

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _hours(spark, sf_dir):
    """Segments of users as filaments, the track in hours; those of users beyond the first 25 rows are long."""
    return segments(spark, sf_dir).withColumn("track", F.col("track") / 3600)


#: Period, slope of the best line on the grid, both lines of that slope, distances, per filament and per row.
_CHAIN = f"""WITH {SEG}, s AS (SELECT rid, mic, track / 3600 AS x, rot, count(*) OVER (PARTITION BY mic) AS n, dense_rank() OVER (ORDER BY mic) - 1 AS filament FROM seg),
  p AS (SELECT 360.0::DOUBLE / greatest(2, CAST(floor(360.0::DOUBLE / (max(rot) - min(rot)) + 0.3::DOUBLE) AS INTEGER)) AS p FROM s WHERE n >= 25),
  t AS (SELECT rid, mic, x, rot % (SELECT p FROM p) AS o, n FROM s WHERE n >= 25), k AS (SELECT k, CASE WHEN k = 1200 THEN 1.1 ELSE k * (2.2 / 1200) - 1.1 END AS m FROM range(1201) r(k)),
  r AS (SELECT mic, k, m, rid, x, o - m * x AS r, (SELECT p FROM p) AS p FROM t, k), j AS (SELECT *, floor((r - lag(r) OVER w) / p + 0.5) * p AS jump FROM r WINDOW w AS (PARTITION BY mic, k ORDER BY x, rid)),
  u AS (SELECT *, r - coalesce(sum(jump) OVER (PARTITION BY mic, k ORDER BY x, rid ROWS UNBOUNDED PRECEDING), 0) AS u FROM j), b AS (SELECT *, avg(u) OVER (PARTITION BY mic, k) AS b FROM u),
  f AS (SELECT mic, k, any_value(m) AS m, sum(pow(r - b - floor((r - b) / p + 0.5) * p, 2)) AS sse FROM b GROUP BY mic, k), best AS (SELECT abs(m) AS m FROM f ORDER BY round(sse, 6), mic, k LIMIT 1),
  v AS (SELECT t.*, o - m * x AS up, o + m * x AS down, m, (SELECT p FROM p) AS p FROM t, best), c AS (SELECT *, avg(((up % p) + p) % p) OVER (PARTITION BY mic) AS bu, avg(((down % p) + p) % p) OVER (PARTITION BY mic) AS bd FROM v),
  e AS (SELECT *, abs((((up - bu + p / 2) % p) + p) % p - p / 2) AS eu, abs((((down - bd + p / 2) % p) + p) % p - p / 2) AS ed FROM c),
  h AS (SELECT mic, count(*) AS segments, CASE WHEN sum(eu) <= sum(ed) THEN any_value(m) ELSE -any_value(m) END AS slope, least(sum(eu), sum(ed)) AS error, sum(eu) <= sum(ed) AS goes_up FROM e GROUP BY mic),
  g AS (SELECT s.rid, s.filament, coalesce(h.error / h.segments, 0) AS good, coalesce(CASE WHEN h.goes_up THEN e.eu ELSE e.ed END, 0) AS good_segment, e.p FROM s LEFT JOIN h USING (mic) LEFT JOIN e ON e.rid = s.rid)"""


def hom_chain(spark, sf_dir):
    """Every segment with the number of its filament, that filament's mean error on the common slope and its own."""
    rows = K.segment_consistency(_hours(spark, sf_dir), ["mic"])[0]
    return rows.select("rid", "filament", F.round("good", 5).alias("good"), F.round("good_segment", 5).alias("good_segment"))


def hom_filaments(spark, sf_dir):
    """The long filaments by their error on the common slope."""
    filaments = K.segment_consistency(_hours(spark, sf_dir), ["mic"])[1]
    return filaments.select("mic", "filament", "segments", F.round("slope", 6).alias("slope"), F.round("error", 4).alias("error"), "place")


def hom_error_histogram(spark, sf_dir):
    """Errors of the segments of long filaments, in bins of the width that their quartiles give."""
    rows, filaments, _, period = K.segment_consistency(_hours(spark, sf_dir), ["mic"])
    errors = rows.join(filaments.select("mic"), "mic", "left_semi").withColumn("good_segment", F.round("good_segment", 6))
    return K.error_histogram(errors, "good_segment", (period or 360.0) / 2).select("bin", F.round("center", 6).alias("center"), "n")


def hom_error_profile(spark, sf_dir):
    """The peak and the tail of that histogram."""
    rows, filaments, slope, period = K.segment_consistency(_hours(spark, sf_dir), ["mic"])
    fit = K.error_profile(rows.join(filaments.select("mic"), "mic", "left_semi"), "good_segment", period or 360.0)
    return spark.range(1).select(F.lit(slope).cast("double").alias("slope"), F.lit(period).cast("double").alias("period"), *[F.lit(v).alias(k) for k, v in fit.items()])


QUERIES |= {f.__name__: f for f in (hom_chain, hom_filaments, hom_error_histogram, hom_error_profile)}
SQL["hom_chain"] = f"{_CHAIN} SELECT rid, CAST(filament AS INTEGER) AS filament, round(good, 5) AS good, round(good_segment, 5) AS good_segment FROM g"
SQL["hom_filaments"] = f"{_CHAIN} SELECT mic, CAST(filament AS INTEGER) AS filament, segments, round(slope, 6) AS slope, round(error, 4) AS error, CAST(row_number() OVER (ORDER BY round(error, 6), mic) AS INTEGER) AS place FROM h JOIN (SELECT DISTINCT mic, filament FROM s) USING (mic)"
SQL["hom_error_histogram"] = f"""{_CHAIN}, d AS (SELECT round(good_segment, 6) AS v, p / 2 AS high FROM g WHERE p IS NOT NULL),
  w AS (SELECT any_value(high) AS high, 2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / pow(count(*), 1.0::DOUBLE / 3) AS width FROM d),
  n AS (SELECT high, CASE WHEN width > 0 THEN CAST(ceil(high / width) AS BIGINT) ELSE 1 END AS bins FROM w), a AS (SELECT CAST(least(floor(v / n.high * bins), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM d, n GROUP BY 1)
  SELECT r.bin, round((r.bin + 0.5) * (n.high / n.bins), 6) AS center, coalesce(a.n, 0) AS n FROM n, range(n.bins) r(bin) LEFT JOIN a ON a.bin = r.bin"""


def angle_quality(spark, sf_dir):
    """Filaments with deviations of their angles, rates of all pairs and means of the score."""
    q = L.angle_quality(_hours(spark, sf_dir), ("score",))
    return q.select("mic", "tube", "segments", *[F.round(c, 3).alias(c) for c in ("tilt_mean", "tilt_std", "psi_std", "rot_std", "rate_median", "rate_mad", "score_mean", "score_std")])


def angle_sigmas(spark, sf_dir):
    """Segments with the deviations of their filament's angles."""
    return L.with_angle_sigmas(_hours(spark, sf_dir)).select("rid", "tilt_sigma", "psi_sigma", "rot_sigma")


def length_with_box(spark, sf_dir):
    """Filaments with their length and a box of 36 (hours stand for angstroms)."""
    return L.lengths_with_box(_hours(spark, sf_dir), 36.0).select("mic", "tube", F.round("length", 4).alias("length"))


def _std(x: str) -> str:
    return f"degrees(sqrt(-2 * ln(least(1.0, sqrt(pow(avg(sin(radians({x}))), 2) + pow(avg(cos(radians({x}))), 2))))))"


_QUALITY = f"""WITH {SEG}, s AS (SELECT mic, tube, rid, track / 3600 AS x, rot, tilt, psi, score FROM seg), t AS (SELECT *, ((rot - lag(rot) OVER w + 180) % 360 + 360) % 360 - 180 AS turn, x - lag(x) OVER w AS way, first_value(rot) OVER w AS f FROM s WINDOW w AS (PARTITION BY mic, tube ORDER BY x, rid)),
  u AS (SELECT *, turn / nullif(way, 0) AS step, f + sum(coalesce(turn, 0)) OVER (PARTITION BY mic, tube ORDER BY x, rid ROWS UNBOUNDED PRECEDING) AS u FROM t),
  g AS (SELECT mic, tube, count(*) AS segments, (degrees(atan2(avg(sin(radians(tilt))), avg(cos(radians(tilt))))) + 360) % 360 AS tilt_mean, {_std('tilt')} AS tilt_std, {_std('2 * psi')} / 2 AS psi_std, CASE WHEN count(step) > 0 THEN {_std('step')} ELSE 0 END AS rot_std, avg(score) AS score_mean, stddev_pop(score) AS score_std FROM u GROUP BY mic, tube)"""
QUERIES |= {f.__name__: f for f in (angle_quality, angle_sigmas, length_with_box)}
SQL["angle_quality"] = f"""{_QUALITY}, p AS (SELECT a.mic, a.tube, abs((b.u - a.u) / (b.x - a.x)) AS rate FROM u a JOIN u b ON a.mic = b.mic AND a.tube = b.tube AND a.x < b.x),
  m AS (SELECT mic, tube, median(rate) AS m FROM p GROUP BY mic, tube), d AS (SELECT p.mic, p.tube, any_value(m) AS rate_median, median(abs(rate - m)) AS rate_mad FROM p JOIN m USING (mic, tube) GROUP BY p.mic, p.tube)
  SELECT g.mic, g.tube, segments, round(tilt_mean, 3) AS tilt_mean, round(tilt_std, 3) AS tilt_std, round(psi_std, 3) AS psi_std, round(rot_std, 3) AS rot_std, round(coalesce(rate_median, 0), 3) AS rate_median, round(coalesce(rate_mad, 0), 3) AS rate_mad, round(score_mean, 3) AS score_mean, round(score_std, 3) AS score_std FROM g LEFT JOIN d USING (mic, tube)"""
SQL["angle_sigmas"] = f"{_QUALITY} SELECT rid, round(tilt_std, 2) AS tilt_sigma, round(psi_std, 2) AS psi_sigma, round(rot_std, 2) AS rot_sigma FROM s JOIN g USING (mic, tube)"
SQL["length_with_box"] = f"WITH {SEG} SELECT mic, tube, round((max(track) - min(track)) / 3600 + 36, 4) AS length FROM seg GROUP BY mic, tube"
