"""Queries on conventions, symmetry, shells and averages, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import scores
from ..functions import symmetry as Y
from ..operators import averages, conventions, shells
from ..operators import joins as J
from ..operators.filaments import rebased
from .views import SEG, read, segments

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(segments(spark, sf_dir))
    if sql:
        SQL[name] = f"WITH RECURSIVE {SEG}{'' if sql.startswith(',') else ' '}{sql}"


def _e(name: str, build, sql: str) -> None:
    """build: of neighbouring embeddings (vec_id, a, b); sql: over the view pair."""
    QUERIES[name] = lambda spark, sf_dir: build(neighbours(read(spark, sf_dir, "embeddings")))
    SQL[name] = f"WITH pair AS (SELECT x.vec_id, CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1){sql}"


def neighbours(e: DataFrame) -> DataFrame:
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


def coefficients(pairs: DataFrame) -> DataFrame:
    """Two arrays as complex numbers, real and imaginary parts in turn; the place is the shell."""
    placed = pairs.withColumn("shell", F.explode(F.sequence(F.lit(0), F.floor(F.size("a") / 2).cast("int") - 1)))
    part = lambda s, k: F.get(s, 2 * F.col("shell") + k).cast("double")
    return placed.select("vec_id", "shell", *[part(s, k).alias(f"{n}_{s}") for s in "ab" for k, n in enumerate(("re", "im"))])


def exported(d: DataFrame) -> DataFrame:
    """Segments with the columns of a structured export."""
    columns = {
        "blob/idx": F.col("rid"), "blob/path": F.concat(F.col("mic").cast("string"), F.lit(".mrcs")), "blob/psize_A": F.col("apix"),
        "ctf/df1_A": F.col("defocus_u"), "ctf/df2_A": F.col("defocus_v"), "ctf/df_angle_rad": F.radians("psi"),
        "alignments2D/class": F.col("cls"), "alignments2D/pose": F.radians("rot"), "alignments2D/shift": F.array("x", "y"),
        "location/center_x_frac": F.col("x") / 100, "location/center_y_frac": F.col("y") / 100, "location/micrograph_shape": F.array(F.lit(4096), F.lit(4000)),
        "filament/filament_uid": F.col("cls") + 5000, "filament/position_A": F.col("track"),
    }
    return d.select("rid", *[c.alias(n) for n, c in columns.items()])


def _quaternion():
    return A.euler_to_quaternion(F.col("rot"), F.col("tilt"), F.col("psi"))


_POINT, _OTHER = ("x", "y", "score"), ("y", "x", "score")
_D2 = [f"(({a}x) - y) * (({a}x) - y) + (({b}y) - x) * (({b}y) - x) + (({c}score) - score) * (({c}score) - score)" for a, b, c in (("", "", ""), ("-", "-", ""), ("", "-", "-"), ("-", "", "-"))]
_HALF = "radians(rot) / 2 AS a, radians(tilt) / 2 AS b, radians(psi) / 2 AS c"
_SHELL = ", s AS (SELECT vec_id, a, b, unnest(range(len(a) // 2)) AS k FROM pair), c AS (SELECT vec_id, CAST(k AS INTEGER) AS shell, a[2 * k + 1] AS ra, a[2 * k + 2] AS ia, b[2 * k + 1] AS rb, b[2 * k + 2] AS ib FROM s)"
_FSC = "coalesce(sum(ra * rb + ia * ib) / nullif(sqrt(sum(ra * ra + ia * ia) * sum(rb * rb + ib * ib)), 0), 0)"

_q("convert_to_star", lambda d: conventions.to_star(exported(d)).select("rid", "rlnImageName", "rlnClassNumber", *[F.round(c, 2).alias(c) for c in ("rlnDefocusU", "rlnDefocusV", "rlnDefocusAngle", "rlnAnglePsi", "rlnCoordinateX", "rlnHelicalTrackLengthAngst")], "rlnOriginXAngst", "rlnHelicalTubeID"),
   """SELECT rid, printf('%06d@%s.mrcs', rid + 1, CAST(mic AS VARCHAR)) AS "rlnImageName", CAST(cls + 1 AS INTEGER) AS "rlnClassNumber", round(defocus_u, 2) AS "rlnDefocusU", round(defocus_v, 2) AS "rlnDefocusV", round(degrees(radians(psi)), 2) AS "rlnDefocusAngle",
  -round(degrees(radians(rot)), 2) AS "rlnAnglePsi", round(-round(x, 2) * apix, 6) AS "rlnOriginXAngst", round(x / 100 * 4000, 2) AS "rlnCoordinateX", round(track - min(track) OVER (PARTITION BY mic, cls), 2) AS "rlnHelicalTrackLengthAngst",
  CAST(dense_rank() OVER (PARTITION BY mic ORDER BY cls) AS INTEGER) AS "rlnHelicalTubeID" FROM seg""")  # fmt: skip
def exported_poses(d: DataFrame) -> DataFrame:
    """Segments with the columns of a structured export after a 3D refinement."""
    columns = {
        "blob/psize_A": F.col("apix"), "ctf/accel_kv": F.lit(300.0), "ctf/cs_mm": F.col("cs"), "ctf/amp_contrast": F.lit(0.1), "ctf/phase_shift_rad": F.radians("tilt"), "ctf/bfactor": F.col("x"), "ctf/scale": F.col("y"),
        "ctf/tilt_A": F.array("x", "y"), "ctf/anisomag": F.array("x", "y", "rot", "psi"), "alignments3D/split": F.col("cls"), "alignments3D/class": F.col("cls"), "alignments3D/cross_cor": F.col("score"),
        "alignments3D/pose": F.array(F.radians("psi") / 9, F.radians("tilt") / 9, F.radians("rot") / 9), "alignments3D/shift": F.array(F.col("x"), F.col("x") * 0.3 + 0.0013), "filament/filament_pose": F.radians(F.col("rot") * 0.9 + 0.0173), "location/exp_group_id": F.col("cls") + 2, "micrograph_blob/path": F.col("image"),
    }
    return d.select("rid", *[c.alias(n) for n, c in columns.items()])


_POSE = ["rlnVoltage", "rlnSphericalAberration", "rlnAmplitudeContrast", "rlnPhaseShift", "rlnCtfBfactor", "rlnCtfScalefactor", "rlnBeamTiltX", "rlnMagMat00", "rlnMagMat11", "rlnLogLikeliContribution", "rlnAngleRot", "rlnAngleTilt", "rlnAnglePsi", "rlnOriginYAngst", "rlnAnglePsiPrior", "rlnAngleTiltPrior"]
_q("convert_poses_to_star", lambda d: conventions.to_star(exported_poses(d)).select("rid", "rlnRandomSubset", "rlnClassNumber", "rlnOpticsGroup", "rlnMicrographName", *[F.round(c, 5).alias(c) for c in _POSE]),
   """, r AS (SELECT *, radians(psi) / 9 AS a, radians(tilt) / 9 AS b, radians(rot) / 9 AS c FROM seg), t AS (SELECT *, sqrt(a * a + b * b + c * c) AS t FROM r), q AS (SELECT *, cos(t / 2) AS w, a * sin(t / 2) / t AS qx, b * sin(t / 2) / t AS qy, c * sin(t / 2) / t AS qz FROM t)
  SELECT rid, CAST(cls + 1 AS INTEGER) AS "rlnRandomSubset", CAST(cls + 1 AS INTEGER) AS "rlnClassNumber", CAST(cls + 2 AS INTEGER) AS "rlnOpticsGroup", image AS "rlnMicrographName", CAST(300.0 AS DOUBLE) AS "rlnVoltage", cs AS "rlnSphericalAberration", CAST(0.1 AS DOUBLE) AS "rlnAmplitudeContrast", round(degrees(radians(tilt)), 5) AS "rlnPhaseShift",
  round(x, 5) AS "rlnCtfBfactor", round(y, 5) AS "rlnCtfScalefactor", round(round(asin(x / cs * 1e-7) * 1e3, 8), 5) AS "rlnBeamTiltX", round(x, 5) AS "rlnMagMat00", round(psi, 5) AS "rlnMagMat11", round(score, 5) AS "rlnLogLikeliContribution",
  round((((degrees(atan2(qz, w) - atan2(qx, qy)) + 180) % 360) + 360) % 360 - 180, 5) AS "rlnAngleRot", round(degrees(2 * atan2(sqrt(qx * qx + qy * qy), sqrt(w * w + qz * qz))), 5) AS "rlnAngleTilt", round((((degrees(atan2(qz, w) + atan2(qx, qy)) + 180) % 360) + 360) % 360 - 180, 5) AS "rlnAnglePsi",
  round(round(round(x * 0.3::DOUBLE + 0.0013::DOUBLE, 2) * apix, 6), 5) AS "rlnOriginYAngst", round(round(-degrees(radians(rot * 0.9::DOUBLE + 0.0173::DOUBLE)), 1), 5) AS "rlnAnglePsiPrior", CAST(90.0 AS DOUBLE) AS "rlnAngleTiltPrior" FROM q""")  # fmt: skip
_q("symmetry_point_distance", lambda d: d.select("rid", F.round(Y.point_distance(tuple(map(F.col, _POINT)), tuple(map(F.col, _OTHER)), "D2"), 4).alias("distance")), f"SELECT rid, round(sqrt(least({', '.join(_D2)})), 4) AS distance FROM seg")
_q("symmetry_set_distance", lambda d: d.groupBy("mic").agg(F.round(Y.set_distance(tuple(map(F.col, _POINT)), tuple(map(F.col, _OTHER)), "D2", "rmse"), 4).alias("rmse")), f"SELECT mic, round(sqrt(least({', '.join(f'avg({s})' for s in _D2)})), 4) AS rmse FROM seg GROUP BY mic")
_q("symmetry_rotation_distance", lambda d: d.select("rid", F.round(Y.rotation_distance(_quaternion(), tuple(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)), "C2"), 3).alias("degrees")), f"SELECT rid, round(2 * degrees(acos(least(1.0, greatest(abs(cos(b) * cos(a + c)), abs(cos(b) * sin(a + c)))))), 3) AS degrees FROM (SELECT rid, {_HALF} FROM seg)")
_q("nearest_match_range_join", lambda d: J.nearest_match(d.where("score > 0"), d.where("score < 50"), ["mic"], "x", "y", 2.0, "rid").select("rid", "match", F.round("apart", 6).alias("apart")), ", p AS (SELECT a.rid, b.rid AS match, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS apart FROM seg a JOIN seg b ON a.mic = b.mic AND a.score > 0 AND b.score < 50), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY apart, match) AS n FROM p WHERE apart <= 2) SELECT rid, match, round(apart, 6) AS apart FROM r WHERE n = 1")
_CELLS = [(i, j) for i in range(4) for j in range(i, 4)]
_AT = lambda i, j: f"m{min(i, j)}{max(i, j)}"
_TRACE = " + ".join(f"{_AT(i, k)} * {_AT(k, i)}" for i in range(4) for k in range(4))
_SQUARED = ", ".join(f"({' + '.join(f'{_AT(i, k)} * {_AT(k, j)}' for k in range(4))}) / ({_TRACE}) AS {_AT(i, j)}" for i, j in _CELLS)
_LARGEST = " ".join(f"WHEN m{i}{i} >= greatest(m00, m11, m22, m33) THEN [{', '.join(_AT(i, j) for j in range(4))}]" for i in range(4))
# The axis of the largest eigenvalue, by squaring the matrix 40 times.
_q("average_rotation", lambda d: averages.average_rotation(d, ["mic", "tube"]).select("mic", "tube", *[F.round(c, 3).alias(c) for c in ("rot", "tilt", "psi")]),
   f""", h AS (SELECT mic, tube, {_HALF} FROM seg), q AS (SELECT mic, tube, [cos(b) * cos(a + c), sin(b) * sin(c - a), sin(b) * cos(c - a), cos(b) * sin(a + c)] AS q FROM h), s AS (SELECT mic, tube, {', '.join(f'sum(q[{i + 1}] * q[{j + 1}]) AS {_AT(i, j)}' for i, j in _CELLS)} FROM q GROUP BY mic, tube),
  p AS (SELECT 0 AS turn, * FROM s UNION ALL SELECT turn + 1, mic, tube, {_SQUARED} FROM p WHERE turn < 40), v AS (SELECT mic, tube, CASE {_LARGEST} END AS v FROM p WHERE turn = 40), e AS (SELECT mic, tube, v[1] AS w, v[2] AS x, v[3] AS y, v[4] AS z FROM v)
  SELECT mic, tube, round((((degrees(atan2(z, w) - atan2(x, y)) + 180) % 360) + 360) % 360 - 180, 3) AS rot, round(degrees(2 * atan2(sqrt(x * x + y * y), sqrt(w * w + z * z))), 3) AS tilt, round((((degrees(atan2(z, w) + atan2(x, y)) + 180) % 360) + 360) % 360 - 180, 3) AS psi FROM e""")  # fmt: skip
_q("elbow_point", lambda d: averages.elbow(d.select("mic", "rid", "score"), ["mic"], "rid", "score"), """, e AS (SELECT mic, min(rid) AS x0, max(rid) AS x1, arg_min(score, rid) AS y0, arg_max(score, rid) AS y1 FROM seg GROUP BY mic),
  f AS (SELECT mic, rid, round(abs((x1 - x0) * (score - y0) - (y1 - y0) * (rid - x0)), 6) AS away FROM seg JOIN e USING (mic)), r AS (SELECT mic, rid, row_number() OVER (PARTITION BY mic ORDER BY away DESC, rid) AS n FROM f) SELECT mic, rid FROM r WHERE n = 1""")  # fmt: skip
_q("pitch_near_strand", lambda d: d.select("rid", F.round(A.twist_to_pitch_near_strand(F.col("psi") + 0.5, F.lit(2.4)), 4).alias("pitch")), ", t AS (SELECT rid, abs(psi + 0.5) AS one, abs(((psi + 0.5) * 2 + 180) % 360 - 180) AS two FROM seg) SELECT rid, round(CASE WHEN two < 90 THEN 2.4 * 2 * 360.0 / two ELSE 2.4 * 360.0 / one END, 4) AS pitch FROM t")
_q("angular_errors", lambda d: rebased(d).select("rid", F.round(A.fit_error(F.col("rot"), F.col("track0"), 0.001, 5.0), 4).alias("error")), ", b AS (SELECT rid, rot - ((track - min(track) OVER (PARTITION BY mic, tube)) * 0.001 + 5.0) AS e FROM seg) SELECT rid, round(((e + 180) % 360 + 360) % 360 - 180, 4) AS error FROM b")
_e("shell_correlation", lambda p: shells.shell_correlation(coefficients(p), []).select("shell", "n", F.round("fsc", 6).alias("fsc")), f"{_SHELL} SELECT shell, count(*) AS n, round({_FSC}, 6) AS fsc FROM c GROUP BY shell")
_e("shell_crossing", lambda p: shells.crossing(shells.shell_correlation(coefficients(p), ["vec_id"]), ["vec_id"]).select("vec_id", F.round("crossing", 4).alias("crossing")), f"{_SHELL}, f AS (SELECT vec_id, shell, {_FSC} AS fsc FROM c GROUP BY vec_id, shell), l AS (SELECT *, lag(fsc) OVER w AS f, lag(shell) OVER w AS s FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY shell)) SELECT vec_id, round(min(CASE WHEN f >= 0.143 AND fsc < 0.143 THEN s + (f - 0.143) / (f - fsc) * (shell - s) END), 4) AS crossing FROM l GROUP BY vec_id")
_e("array_scores", lambda p: p.select("vec_id", F.round(scores.correlation("a", "b"), 6).alias("correlation"), F.round(scores.r_factor("a", "b"), 6).alias("r_factor")), ", u AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM pair) SELECT vec_id, round(coalesce(corr(x, y), 0), 6) AS correlation, round(1 / (1 + sum(abs(x - y)) / sum(abs(y))), 6) AS r_factor FROM u GROUP BY vec_id")
_e("mutual_information", lambda p: scores.mutual_information(p, "vec_id", "a", "b", 8).select("vec_id", F.round("score", 8).alias("score")), """, u AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM pair), l AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM u WINDOW w AS (PARTITION BY vec_id)),
  c AS (SELECT vec_id, least(floor((x - x0) / (x1 - x0) * 8), 7) AS p, least(floor((y - y0) / (y1 - y0) * 8), 7) AS q, count(*) AS n FROM l GROUP BY ALL), h AS (SELECT vec_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM c GROUP BY vec_id),
  a1 AS (SELECT vec_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT vec_id, p, sum(n) AS n FROM c GROUP BY vec_id, p) GROUP BY vec_id), b1 AS (SELECT vec_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT vec_id, q, sum(n) AS n FROM c GROUP BY vec_id, q) GROUP BY vec_id)
  SELECT h.vec_id, round((a1.h + b1.h) / h.h - 1, 8) AS score FROM h JOIN a1 USING (vec_id) JOIN b1 USING (vec_id)""")
