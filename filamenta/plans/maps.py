"""Registered queries of local measures and Fourier chains of maps, and their SQL twins by plain sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curves, fourier, local
from ..operators import windows as W
from ..operators.volumes import voxels
from .geometry import neighbours
from .views import read

QUERIES: dict = {}
SQL: dict[str, str] = {}

_VOX = "e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)"
_CUBE = f"{_VOX}, vox AS (SELECT vec_id AS map, CAST(i // 16 AS INTEGER) AS z, CAST(i // 4 % 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x, CAST(v AS DOUBLE) AS v FROM e)"


def _images(e: DataFrame) -> DataFrame:
    """Neighbouring embeddings as two images of 8 x 8 pixels."""
    flat = neighbours(e).select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("_i", "_p"))
    i = F.col("_i")
    return flat.select("vec_id", F.floor(i / 8).cast("int").alias("y"), (i % 8).cast("int").alias("x"), F.col("_p.a").cast("double").alias("a"), F.col("_p.b").cast("double").alias("b"))


QUERIES["structural_similarity"] = lambda spark, sf_dir: local.structural_similarity(_images(read(spark, sf_dir, "embeddings")), "vec_id", ["y", "x"]).select("vec_id", F.round("ssim", 6).alias("ssim"))
SQL["structural_similarity"] = f"""WITH {_VOX}, im AS (SELECT p.vec_id, p.i // 8 AS y, p.i % 8 AS x, CAST(p.v AS DOUBLE) AS a, CAST(q.v AS DOUBLE) AS b FROM e p JOIN e q ON q.vec_id = p.vec_id + 1 AND q.i = p.i),
  r AS (SELECT vec_id, greatest(max(a) - min(a), max(b) - min(b)) AS r FROM im GROUP BY 1),
  w AS (SELECT vec_id, wy, wx, avg(a) AS ua, avg(b) AS ub, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM im, range(2) p(wy), range(2) q(wx) WHERE y - wy BETWEEN 0 AND 6 AND x - wx BETWEEN 0 AND 6 GROUP BY 1, 2, 3)
  SELECT vec_id, round(avg((2 * ua * ub + (0.01::DOUBLE * r) ** 2) * (2 * c + (0.03::DOUBLE * r) ** 2) / ((ua * ua + ub * ub + (0.01::DOUBLE * r) ** 2) * (va + vb + (0.03::DOUBLE * r) ** 2))), 6) AS ssim FROM w JOIN r USING (vec_id) GROUP BY 1"""

_WIDTH = 1.5
_SOFT = "CASE WHEN d2 = 0 THEN 1.0 WHEN sqrt(d2) <= 1.5 THEN (cos(sqrt(d2) / 1.5 * (pi() / 2)) + 1) / 2 ELSE 0.0 END"


def _cubes(spark, sf_dir) -> DataFrame:
    return voxels(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, 4)


QUERIES["otsu_threshold"] = lambda spark, sf_dir: local.otsu_threshold(_cubes(spark, sf_dir), "map", bins=16).select("map", F.round("threshold", 6).alias("threshold"))
SQL["otsu_threshold"] = f"""WITH {_CUBE}, m AS (SELECT map, min(v) AS lo, (max(v) - min(v)) / 16 AS w FROM vox GROUP BY 1), b AS (SELECT map, least(floor((v - lo) / w), 15) AS k FROM vox JOIN m USING (map) WHERE v <> 0),
  s AS (SELECT c.map, c.t, count(*) FILTER (k <= t) AS l, count(*) FILTER (k > t) AS r, avg(k) FILTER (k <= t) AS a, avg(k) FILTER (k > t) AS z FROM (SELECT DISTINCT map, k AS t FROM b WHERE k > 0) c JOIN b ON b.map = c.map GROUP BY 1, 2),
  o AS (SELECT map, arg_max(t, {{'s': round(CASE WHEN r > 0 THEN CAST(l AS DOUBLE) * r * (a - z) ** 2 ELSE 0 END, 6), 't': -t}}) AS t FROM s GROUP BY 1) SELECT map, round(lo + (t + 1) * w, 6) AS threshold FROM m JOIN o USING (map)"""

QUERIES["soft_mask"] = lambda spark, sf_dir: local.soft_mask(_cubes(spark, sf_dir), "map", ["z", "y", "x"], F.col("v") > 0.2, _WIDTH).select("map", "z", "y", "x", F.round("mask", 6).alias("mask"))
SQL["soft_mask"] = f"""WITH {_CUBE}, d AS (SELECT a.map, a.z, a.y, a.x, min((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d2 FROM vox a LEFT JOIN vox b ON b.map = a.map AND b.v > 0.2 GROUP BY ALL) SELECT map, z, y, x, round({_SOFT}, 6) AS mask FROM d"""


def _true_fsc(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    halves = voxels(e, "vec_id", "embedding", 4, 4).withColumn("half", F.lit("a")).unionByName(voxels(e.withColumn("vec_id", F.col("vec_id") - 1), "vec_id", "embedding", 4, 4).withColumn("half", F.lit("b")))
    both = halves.join(e.select(F.col("vec_id").alias("map")).join(e.select((F.col("vec_id") - 1).alias("map")), "map"), "map", "left_semi")
    curve = fourier.true_shell_correlation(both, "map", {"z": 4, "y": 4, "x": 4}, F.col("v") > 0.2, _WIDTH, 0)
    return curve.select("map", "shell", *[(F.round(c, 4) + 0.0).alias(c) for c in ("unmasked", "randomised", "masked", "corrected")])


QUERIES["true_shell_correlation"] = _true_fsc
_SUM = "sum({v} * cos(2 * pi() * (f.z * g.z + f.y * g.y + f.x * g.x) / 4)) AS re, -sum({v} * sin(2 * pi() * (f.z * g.z + f.y * g.y + f.x * g.x) / 4)) AS im"
_FSC = "SELECT a.map, s AS shell, CASE WHEN sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im) > 0 THEN sum(a.re * b.re + a.im * b.im) / sqrt(sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)) ELSE 0 END AS fsc FROM {t} a JOIN {t} b ON b.map = a.map AND b.half = 'b' AND b.z = a.z AND b.y = a.y AND b.x = a.x JOIN g ON g.z = a.z AND g.y = a.y AND g.x = a.x WHERE a.half = 'a' GROUP BY 1, 2"
_H = "concat_ws(':', map, half, {k}, '0')"
SQL["true_shell_correlation"] = f"""WITH {_CUBE}, ok AS (SELECT a.vec_id AS map FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
  h AS (SELECT map, 'a' AS half, z, y, x, v FROM vox JOIN ok USING (map) UNION ALL SELECT map - 1, 'b', z, y, x, v FROM vox WHERE map - 1 IN (SELECT map FROM ok)),
  g AS (SELECT z, y, x, (4 - z) % 4 AS oz, (4 - y) % 4 AS oy, (4 - x) % 4 AS ox, CAST(least(round_even(sqrt(least(z, 4 - z) ** 2 + least(y, 4 - y) ** 2 + least(x, 4 - x) ** 2), 0), 2) AS INTEGER) AS s FROM range(4) a(z), range(4) b(y), range(4) c(x)),
  d AS (SELECT a.map, a.half, a.z, a.y, a.x, min((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d2 FROM h a LEFT JOIN h b ON b.map = a.map AND b.half = a.half AND b.v > 0.2 GROUP BY ALL),
  m AS (SELECT map, half, z, y, x, {_SOFT} AS mask FROM d),
  p AS (SELECT map, half, g.z, g.y, g.x, {_SUM.format(v='f.v')} FROM h f, g GROUP BY ALL),
  q AS (SELECT p.*, CASE WHEN (z, y, x) = (oz, oy, ox) THEN 0 WHEN (z, y, x) < (oz, oy, ox) THEN 1 ELSE -1 END * CAST('0x' || substr(md5(CASE WHEN (z, y, x) < (oz, oy, ox) THEN {_H.format(k='z, y, x')} ELSE {_H.format(k='oz, oy, ox')} END), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE * 2 * pi() AS t FROM p JOIN g USING (z, y, x)),
  r AS (SELECT map, half, z, y, x, re * cos(t) - im * sin(t) AS re, re * sin(t) + im * cos(t) AS im FROM q),
  b AS (SELECT map, half, g.z, g.y, g.x, sum(f.re * cos(2 * pi() * (f.z * g.z + f.y * g.y + f.x * g.x) / 4) - f.im * sin(2 * pi() * (f.z * g.z + f.y * g.y + f.x * g.x) / 4)) / 64 AS v FROM r f, g GROUP BY ALL),
  pm AS (SELECT map, half, g.z, g.y, g.x, {_SUM.format(v='f.v')} FROM (SELECT h.map, h.half, h.z, h.y, h.x, v * mask AS v FROM h JOIN m USING (map, half, z, y, x)) f, g GROUP BY ALL),
  bm AS (SELECT map, half, g.z, g.y, g.x, {_SUM.format(v='f.v')} FROM (SELECT b.map, b.half, b.z, b.y, b.x, v * mask AS v FROM b JOIN m USING (map, half, z, y, x)) f, g GROUP BY ALL),
  u AS ({_FSC.format(t='p')}), k AS ({_FSC.format(t='pm')}), n AS ({_FSC.format(t='bm')})
  SELECT map, shell, round(u.fsc, 4) + 0.0 AS unmasked, round(n.fsc, 4) + 0.0 AS randomised, round(k.fsc, 4) + 0.0 AS masked, round(CASE WHEN shell > 0 AND n.fsc < 1 THEN (k.fsc - n.fsc) / (1 - n.fsc) ELSE k.fsc END, 4) + 0.0 AS corrected FROM u JOIN k USING (map, shell) JOIN n USING (map, shell)"""


def _falling(spark, sf_dir) -> DataFrame:
    """Curves that fall from 1: an embedding's entries by size, over the largest; place k of 64 lies at (k + 1) / 64."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.reverse(F.array_sort(F.transform("embedding", lambda v: F.abs(v.cast("double"))))).alias("_v"))
    return e.select("vec_id", F.posexplode("_v").alias("_k", "_x"), F.get("_v", F.lit(0)).alias("_most")).select("vec_id", ((F.col("_k") + 1) / 64).alias("s"), (F.col("_x") / F.col("_most")).alias("f"))


QUERIES["curve_fits"] = lambda spark, sf_dir: curves.falling_fits(_falling(spark, sf_dir), "vec_id", "s", "f").select("vec_id", "model", *[F.round(c, 5).alias(c) for c in ("p", "q", "error")])
_U = "CASE WHEN s > 0 THEN pow(s / p, q) ELSE 0 END"
_MODELS = {
    "butterworth": ("2.0::DOUBLE", f"1 / (1 + {_U})", f"q / p * {_U} / (1 + {_U}) ** 2", f"-({_U}) * ln(s / p) / (1 + {_U}) ** 2"),
    "fermi": ("s / 5", "(exp(-p / q) + 1) / (exp((s - p) / q) + 1)", "(-exp(-p / q) / q * (exp((s - p) / q) + 1) + (exp(-p / q) + 1) * exp((s - p) / q) / q) / (exp((s - p) / q) + 1) ** 2", "(exp(-p / q) * p / (q * q) * (exp((s - p) / q) + 1) + (exp(-p / q) + 1) * exp((s - p) / q) * (s - p) / (q * q)) / (exp((s - p) / q) + 1) ** 2"),
}


def _fit_sql(model: str) -> str:
    """One model's rounds: a row a curve and round, whose normal equations are sums over the curve's points."""
    first, value, dp, dq = _MODELS[model]
    sums = f"sum((f - ({value})) ** 2) AS e, sum(({dp}) ** 2) AS pp, sum(({dp}) * ({dq})) AS pq, sum(({dq}) ** 2) AS qq, sum(({dp}) * (f - ({value}))) AS pr, sum(({dq}) * (f - ({value}))) AS qr"
    return f"""{model}(r, vec_id, p, q, d, e, pp, pq, qq, pr, qr) AS (
    SELECT 0, vec_id, p, q, 0.001::DOUBLE, {sums} FROM (SELECT c.vec_id, c.s AS p, {first.replace('s ', 'c.s ')} AS q FROM c WHERE k = 32) JOIN c USING (vec_id) GROUP BY vec_id, p, q
    UNION ALL
    (WITH now AS (SELECT * FROM {model} WHERE r < 60), det AS (SELECT *, pp * (1 + d) * qq * (1 + d) - pq * pq AS t FROM now),
      step AS (SELECT vec_id, p + (qq * (1 + d) * pr - pq * qr) / t AS p, q + (pp * (1 + d) * qr - pq * pr) / t AS q FROM det WHERE t <> 0),
      tried AS (SELECT vec_id, p, q, {sums} FROM (SELECT * FROM step WHERE p > 0 AND q > 0) JOIN c USING (vec_id) GROUP BY vec_id, p, q)
    SELECT n.r + 1, n.vec_id, CASE WHEN x.e <= n.e * (1 + 1e-13::DOUBLE) THEN x.p ELSE n.p END, CASE WHEN x.e <= n.e * (1 + 1e-13::DOUBLE) THEN x.q ELSE n.q END, CASE WHEN x.e <= n.e * (1 + 1e-13::DOUBLE) THEN n.d / 10 ELSE n.d * 10 END,
      {', '.join(f'CASE WHEN x.e <= n.e * (1 + 1e-13::DOUBLE) THEN x.{c} ELSE n.{c} END' for c in ('e', 'pp', 'pq', 'qq', 'pr', 'qr'))} FROM now n LEFT JOIN tried x USING (vec_id)))"""


SQL["curve_fits"] = f"""WITH RECURSIVE a AS (SELECT vec_id, list_reverse_sort(list_transform(CAST(embedding AS DOUBLE[]), lambda v: abs(v))) AS v FROM embeddings),
  c AS (SELECT vec_id, k, (k + 1) / 64 AS s, v[k + 1] / v[1] AS f FROM a, range(64) x(k)), {_fit_sql('butterworth')}, {_fit_sql('fermi')}
  SELECT vec_id, CASE WHEN g.e / 64 < b.e / 64 THEN 'fermi' ELSE 'butterworth' END AS model, round(CASE WHEN g.e / 64 < b.e / 64 THEN g.p ELSE b.p END, 5) AS p, round(CASE WHEN g.e / 64 < b.e / 64 THEN g.q ELSE b.q END, 5) AS q, round(least(g.e / 64, b.e / 64), 5) AS error
  FROM (SELECT * FROM butterworth WHERE r = 60) b JOIN (SELECT * FROM fermi WHERE r = 60) g USING (vec_id)"""


def _windows(spark, sf_dir) -> DataFrame:
    """Windows of 4 x 4 pixels around two places of each embedding as a micrograph of 8 x 8 pixels, in tiles of 3."""
    e = read(spark, sf_dir, "embeddings")
    i = F.col("_i")
    pixels = e.select("vec_id", F.posexplode("embedding").alias("_i", "v")).select("vec_id", F.floor(i / 8).cast("int").alias("y"), (i % 8).cast("int").alias("x"), "v")
    particles = e.select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("rid", F.col("vec_id") * 2 + F.col("k"))
    out = W.windows(particles, W.tiles(pixels, "vec_id", 3), "vec_id", (F.col("rid") * 3) % 9 + 0.25, F.col("rid") % 7 + 0.75, 4, tile=3, sign=-1, normalise=True)
    return out.select("rid", "inside", F.posexplode("values").alias("i", "v")).select("rid", "inside", "i", (F.round("v", 6) + 0.0).alias("v"))


QUERIES["particle_windows"] = _windows
SQL["particle_windows"] = f"""WITH {_VOX}, p AS (SELECT vec_id, vec_id * 2 + k AS rid FROM embeddings, range(2) r(k)),
  w AS (SELECT p.rid, CAST(j AS INTEGER) AS i, CAST(e.v AS DOUBLE) AS v FROM p CROSS JOIN range(16) r(j) LEFT JOIN e ON e.vec_id = p.vec_id AND (rid * 3) % 9 - 2 + j // 4 BETWEEN 0 AND 7 AND rid % 7 + 1 - 2 + j % 4 BETWEEN 0 AND 7 AND e.i = ((rid * 3) % 9 - 2 + j // 4) * 8 + rid % 7 - 1 + j % 4),
  f AS (SELECT rid, i, count(v) OVER (PARTITION BY rid) AS inside, coalesce(v, avg(v) OVER (PARTITION BY rid)) AS v FROM w),
  s AS (SELECT rid, i, inside, max(v) OVER r + min(v) OVER r - v AS v FROM f WINDOW r AS (PARTITION BY rid))
  SELECT rid, inside, i, round((v - avg(v) OVER r) / stddev_pop(v) OVER r, 6) + 0.0 AS v FROM s WINDOW r AS (PARTITION BY rid)"""
