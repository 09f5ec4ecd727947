"""Registered queries of poses between refinements of different symmetry, and their SQL twins in quaternions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mismatch as M
from .views import SEG, segments

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _refined(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Segments refined twice: under C2, and under C3 turned by 17.5 degrees and whole steps about z."""
    one = segments(spark, sf_dir).select(F.col("rid").alias("uid"), "mic", "x", "y", F.array(F.col("psi") / 180, F.col("rot") / 300, F.col("tilt") / 150).alias("pose"))
    return one, M.turned(one, "pose", 17.5 + 120.0 * (F.col("uid") % 3))


def _both(one: DataFrame, other: DataFrame) -> DataFrame:
    shown = lambda df, n: df.select("pair", F.col("uid").alias(f"uid{n}"), *[(F.round(F.get("pose", F.lit(k)), 5) + 0.0).alias(f"p{n}{a}") for k, a in enumerate("xyz")])
    return shown(one, 1).join(shown(other, 2), "pair").drop("pair")


def poses_reassigned(spark, sf_dir):
    one, other = _refined(spark, sf_dir)
    return _both(*M.reassigned(one, other, "pose", 2, 3, axis=10.0)[:2])


def poses_reassigned_in_space(spark, sf_dir):
    """The same particles under other uids, so that partners are found by place and axis."""
    one, other = _refined(spark, sf_dir)
    other = other.withColumn("uid", -F.col("uid") - 1).withColumn("x", F.col("x") + 0.3)
    return _both(*M.reassigned(one, other, "pose", 2, 3, distance=0.5, axis=0.001)[:2])


QUERIES |= {f.__name__: f for f in (poses_reassigned, poses_reassigned_in_space)}

_TURN = "{c} * {w} - {s} * {z}, {c} * {x} - {s} * {y}, {c} * {y} + {s} * {x}, {c} * {z} + {s} * {w}"
_STEP = "CASE WHEN d % 60.0 < 0 THEN (d % 60.0 + 60.0) % 60.0 ELSE d % 60.0 END"
_POSES = f"""WITH {SEG}, v AS (SELECT rid, mic, x AS px, y AS py, psi / 180 AS a, rot / 300 AS b, tilt / 150 AS c, radians(17.5 + 120.0 * (rid % 3)) / 2 AS h FROM seg),
  n AS (SELECT *, sqrt(a * a + b * b + c * c) AS t FROM v),
  q AS (SELECT rid, mic, px, py, h, cos(t / 2) AS w, CASE WHEN t > 1e-12 THEN sin(t / 2) / t ELSE 0.5 END AS k, a, b, c FROM n),
  q1 AS (SELECT rid, mic, px, py, h, w, k * a AS x, k * b AS y, k * c AS z FROM q),
  q2(rid, mic, px, py, w, x, y, z) AS (SELECT rid, mic, px, py, {_TURN.format(c='cos(h)', s='sin(h)', w='w', x='x', y='y', z='z')} FROM q1),
  e1 AS (SELECT *, degrees(CASE WHEN x * x + y * y < 1e-14 OR w * w + z * z < 1e-14 THEN atan2(2 * (x * y + w * z), 1 - 2 * (y * y + z * z)) ELSE atan2(x * z + w * y, w * x - y * z) END) AS e FROM q1),
  e2 AS (SELECT *, degrees(CASE WHEN x * x + y * y < 1e-14 OR w * w + z * z < 1e-14 THEN atan2(2 * (x * y + w * z), 1 - 2 * (y * y + z * z)) ELSE atan2(x * z + w * y, w * x - y * z) END) AS e FROM q2),
"""
#: The steps that bring the difference of both angles next to 17.5, which is the angle between the settings that these rows were made with.
_UNFOLD = """  tried AS (SELECT m.uid1, m.uid2, a, b, round(abs((((f.e + b * 120.0 - g.e - a * 180.0 - 17.5 + 180) % 360) + 360) % 360 - 180), 6) AS away FROM m JOIN e1 g ON g.rid = m.uid1 JOIN e2 f ON f.rid = m.rid2, range(2) x(a), range(3) y(b)),
  chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid2 ORDER BY away, a, b) AS n FROM tried) WHERE n = 1),
  t1(uid1, uid2, w, x, y, z) AS (SELECT c.uid1, c.uid2, {one} FROM chosen c JOIN q1 q ON q.rid = c.uid1),
  t2(uid1, uid2, w, x, y, z) AS (SELECT c.uid1, c.uid2, {two} FROM chosen c JOIN m USING (uid1, uid2) JOIN q2 q ON q.rid = m.rid2)
  SELECT t1.uid1, t1.uid2, {p1}, {p2} FROM t1 JOIN t2 USING (uid2)"""
_POSE = ", ".join("round(CASE WHEN {t}.w < 0 THEN -1 ELSE 1 END * {t}.%s * 2 * atan2(sqrt({t}.x ** 2 + {t}.y ** 2 + {t}.z ** 2), abs({t}.w)) / sqrt({t}.x ** 2 + {t}.y ** 2 + {t}.z ** 2), 5) + 0.0 AS p{n}%s" % (a, a) for a in "xyz")
_REST = _UNFOLD.format(one=_TURN.format(c="cos(radians(a * 180.0) / 2)", s="sin(radians(a * 180.0) / 2)", w="q.w", x="q.x", y="q.y", z="q.z"), two=_TURN.format(c="cos(radians(b * 120.0) / 2)", s="sin(radians(b * 120.0) / 2)", w="q.w", x="q.x", y="q.y", z="q.z"), p1=_POSE.format(t="t1", n=1), p2=_POSE.format(t="t2", n=2))
SQL["poses_reassigned"] = _POSES + "  m AS (SELECT rid AS uid1, rid AS uid2, rid AS rid2 FROM q1 WHERE (17.5 + 120 * (rid % 3)) < 180),\n" + _REST
SQL["poses_reassigned_in_space"] = _POSES + """  pair AS (SELECT a.rid AS uid1, -b.rid - 1 AS uid2, b.rid AS rid2, a.w AS aw, a.x AS ax, a.y AS ay, a.z AS az, b.w AS rw, b.x AS rx, b.y AS ry, b.z AS rz FROM q1 a JOIN q2 b ON a.mic = b.mic AND sqrt((a.px - b.px - 0.3) ** 2 + (a.py - b.py) ** 2) <= 0.5),
  d AS (SELECT uid1, uid2, rid2, rw * aw + rx * ax + ry * ay + rz * az AS w, -rw * ax + rx * aw - ry * az + rz * ay AS x, -rw * ay + rx * az + ry * aw - rz * ax AS y, -rw * az - rx * ay + ry * ax + rz * aw AS z FROM pair),
  ok AS (SELECT uid1, uid2, rid2, round(CASE WHEN w < 0 THEN -z ELSE z END / sqrt(x * x + y * y + z * z), 9) AS up FROM d WHERE CASE WHEN w < 0 THEN -z ELSE z END / sqrt(x * x + y * y + z * z) > cos(radians(0.001))),
  m AS (SELECT arg_min(uid1, {'u': -up, 'i': uid1}) AS uid1, uid2, any_value(rid2) AS rid2 FROM ok GROUP BY uid2),
""" + _REST
