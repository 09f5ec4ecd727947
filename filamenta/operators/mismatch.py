"""Relative angle of two refinements of the same particles under different symmetries."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import wrap
from ..sources.shared import Written
from .selection import drawn


def angle_range(first: int, second: int) -> float:
    """Degrees after which the relative angle of two symmetries repeats."""
    return 360.0 / math.lcm(first, second)


def relative_angle(df: DataFrame, one: str, other: str, first: int, second: int, rid: str, seeds: int = 10, seed: int = 1) -> float | None:
    """The angle in [0, angle_range) by which other is ahead of one: of the differences of some rows (chosen by a hash) that with the least sum of distances from all rows, moved by the mean difference from it. Ties go to the smaller one.

    All turns of a symmetry differ by whole ranges, so distances are taken modulo the range.
    """
    period = angle_range(first, second)
    differ = F.pmod(F.col(other) - F.col(one), F.lit(period))
    rows = df.where(F.col(one).isNotNull() & F.col(other).isNotNull())
    tried = sorted({r[0] for r in rows.orderBy(drawn(rid, seed), rid).limit(seeds).select(differ).collect()})
    if not tried:
        return None
    errors = rows.agg(*[F.sum(F.abs(wrap(differ - F.lit(c), period))).alias(f"e{k}") for k, c in enumerate(tried)]).first()
    best = min(zip((round(e, 6) for e in errors), tried))[1]
    return (best + rows.agg(F.avg(wrap(differ - F.lit(best), period))).first()[0]) % period


def unfolded(df: DataFrame, one: str, other: str, first: int, second: int, angle: float) -> DataFrame:
    """df with both angles turned by those whole symmetry steps of each that bring their difference next to angle; of several, the fewest of the first, then of the second."""
    steps = F.sequence(F.lit(0), F.lit(first * second - 1))
    turn = lambda k: (F.floor(k / second), k % second)

    def away(k: Column) -> Column:
        a, b = turn(k)
        return F.round(F.abs(wrap(F.col(other) + b * (360.0 / second) - F.col(one) - a * (360.0 / first) - angle)), 6)

    k = (F.array_position("_tried", F.array_min("_tried")) - 1).cast("int")
    a, b = F.floor(F.col("_k") / second), F.col("_k") % second
    placed = df.withColumn("_tried", F.transform(steps, away)).withColumn("_k", k).drop("_tried")
    return placed.withColumn(one, (F.col(one) + a * (360.0 / first)) % 360.0).withColumn(other, (F.col(other) + b * (360.0 / second)) % 360.0).drop("_k")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: written out at every use, nested rotations would grow without bound."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _four(q: Column) -> list[Column]:
    return [F.get(q, F.lit(k)) for k in range(4)]


def rotation_of(pose: Column) -> Column:
    """The unit quaternion (array of 4, scalar first) of a rotation vector (array of 3, radians)."""

    def of(v: Column) -> Column:
        x = [F.get(v, F.lit(k)) for k in range(3)]
        share = F.when(x[2] > 1e-12, F.sin(x[2] / 2) / x[2]).otherwise(0.5)
        return F.array(F.cos(x[2] / 2), *[share * F.get(v, F.lit(k)) for k in (0, 1, 3)])

    v = [F.get(pose, F.lit(k)).cast("double") for k in range(3)]
    return _let(F.array(v[0], v[1], F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), v[2]), of)  # the angle stands third


def pose_of(q: Column) -> Column:
    """The rotation vector of a unit quaternion, of an angle of at most pi."""

    def of(p: Column) -> Column:
        w, *v = _four(p)
        length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        return _let(F.array(F.when(length > 1e-12, 2 * F.atan2(length, w) / F.when(length > 1e-12, length)).otherwise(2.0), *v), lambda s: F.array(*[F.get(s, F.lit(0)) * F.get(s, F.lit(k)) for k in (1, 2, 3)]))

    return _let(_let(q, lambda p: F.when(F.get(p, F.lit(0)) < 0, F.transform(p, lambda x: -x)).otherwise(p)), of)


def inverse(q: Column) -> Column:
    return F.transform(q, lambda x, k: F.when(k == 0, x).otherwise(-x))


def times(p: Column, q: Column) -> Column:
    """The rotation q, then p."""

    def of(both: Column) -> Column:
        (a, b, c, d), (w, x, y, z) = _four(both["p"]), _four(both["q"])
        return F.array(a * w - b * x - c * y - d * z, a * x + b * w + c * z - d * y, a * y - b * z + c * w + d * x, a * z + b * y - c * x + d * w)

    return _let(F.struct(p.alias("p"), q.alias("q")), of)


def about_z(degrees: Column) -> Column:
    half = F.radians(degrees) / 2
    return F.array(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))


def first_angle(q: Column) -> Column:
    """The first of the Euler angles about z, x and z (degrees): the turn about the fixed z axis; all of the turn where the middle angle is 0 or 180."""

    def of(p: Column) -> Column:
        w, x, y, z = _four(p)
        flat = (x * x + y * y < 1e-14) | (w * w + z * z < 1e-14)
        return F.degrees(F.when(flat, F.atan2(2 * (x * y + w * z), 1 - 2 * (y * y + z * z))).otherwise(F.atan2(x * z + w * y, w * x - y * z)))

    return _let(q, of)


def with_rotation(df: DataFrame, pose: str, names: tuple[str, str, str, str]) -> DataFrame:
    """df with the unit quaternion (scalar first) of a rotation vector in four columns; each step is a column of its own, worked out once a row in generated code."""
    w, *axis = names
    parts = df.withColumns({c: F.get(pose, F.lit(k)).cast("double") for k, c in enumerate(axis)})
    angle = parts.withColumn(w, F.sqrt(sum((F.col(c) * F.col(c) for c in axis[1:]), F.col(axis[0]) * F.col(axis[0]))))
    share = angle.withColumn("_share", F.when(F.col(w) > 1e-12, F.sin(F.col(w) / 2) / F.col(w)).otherwise(0.5))
    return share.withColumns({w: F.cos(F.col(w) / 2)} | {c: F.col("_share") * F.col(c) for c in axis}).drop("_share")


def turned(df: DataFrame, pose: str, degrees: Column) -> DataFrame:
    """df with poses (rotation vectors) turned about z after their own rotation; their angle is at most pi."""
    w, x, y, z = (F.col(c) for c in _TURNED)
    half = with_rotation(df.withColumn("_half", F.radians(degrees) / 2), pose, _TURNED).withColumns({"_cos": F.cos("_half"), "_sin": F.sin("_half")})
    c, s = F.col("_cos"), F.col("_sin")
    both = half.withColumns(dict(zip(_TURNED, (c * w - s * z, c * x - s * y, c * y + s * x, c * z + s * w))))
    least = both.withColumn("_sign", F.when(w < 0, -1.0).otherwise(1.0)).withColumn("_length", F.sqrt(x * x + y * y + z * z))
    share = F.when(F.col("_length") > 1e-12, 2 * F.atan2(F.col("_length"), F.col("_sign") * w) / F.col("_length")).otherwise(2.0)
    out = least.withColumn("_share", F.col("_sign") * share)
    return out.withColumn(pose, F.array(*[F.col("_share") * v for v in (x, y, z)])).drop(*_TURNED, "_half", "_cos", "_sin", "_sign", "_length", "_share")


_TURNED = ("_tw", "_tx", "_ty", "_tz")
_P, _Q = (tuple(f"_{c}{n}" for c in "wxyz") for n in (1, 2))


def _with_first_angle(df: DataFrame, q: tuple[str, ...], name: str) -> DataFrame:
    """As first_angle, of a quaternion in four columns."""
    w, x, y, z = (F.col(c) for c in q)
    flat = (x * x + y * y < 1e-14) | (w * w + z * z < 1e-14)
    return df.withColumn(name, F.degrees(F.when(flat, F.atan2(2 * (x * y + w * z), 1 - 2 * (y * y + z * z))).otherwise(F.atan2(x * z + w * y, w * x - y * z))))


def _up() -> Column:
    """How much the axis of the turn from _P to _Q points to +z; 1 without a turn."""
    (a, b, c, d), (w, x, y, z) = ([F.col(n) for n in q] for q in (_P, _Q))
    tw = w * a + x * b + y * c + z * d
    tx, ty, tz = -w * b + x * a - y * d + z * c, -w * c + x * d + y * a - z * b, -w * d - x * c + y * b + z * a
    length = F.sqrt(tx * tx + ty * ty + tz * tz)
    return F.when(2 * F.atan2(length, F.abs(tw)) < 1e-6, 1.0).otherwise(F.when(tw < 0, -tz).otherwise(tz) / length)


def _matched(one: DataFrame, other: DataFrame, pose: str, distance: float | None, axis: float | None, micrograph: str, x: str, y: str, uid: str) -> DataFrame:
    """(uid1, uid2, _one, _other): partners as correspondence() finds them, and the first angles of their rotations.

    Rotations are worked out once a row, before rows meet; no side is sent to the driver, as rows times cells are more than Spark reckons with.
    """
    shared = not one.select(uid).join(other.select(uid), uid, "left_semi").isEmpty()

    def side(df: DataFrame, n: int, q: tuple[str, ...], name: str) -> DataFrame:
        places = [] if shared else [F.col(micrograph).alias("_m")]
        rows = df.select(F.col(uid).alias(f"uid{n}"), *places, F.col(x).cast("double").alias(f"_px{n}"), F.col(y).cast("double").alias(f"_py{n}"), F.col(pose).alias("_pose"))
        rows = _with_first_angle(with_rotation(rows, "_pose", q), q, name).drop("_pose")
        return rows.drop(*([f"_px{n}", f"_py{n}"] if shared else []), *(q if axis is None or axis <= 0 else []))

    a, b = side(one, 1, _P, "_one"), side(other, 2, _Q, "_other")
    if shared:
        pairs = a.join(b.hint("merge"), F.col("uid1") == F.col("uid2")).withColumn("_d", F.lit(0.0))
    elif distance is None:
        raise ValueError("the tables share no uid, so partners need a distance")
    else:
        width = 4 * distance or 1.0
        cell = lambda v: F.floor(v / width)
        reach = lambda c: F.lit(distance) + 1e-9 * (F.abs(F.col(c)) + distance)  # noqa: E731  more than rounding takes
        cells = lambda c: F.sequence(cell(F.col(c) - reach(c)), cell(F.col(c) + reach(c)))
        asks = b.withColumn("_i", F.explode(cells("_px2"))).withColumn("_j", F.explode(cells("_py2")))
        apart = F.sqrt(F.pow(F.col("_px1") - F.col("_px2"), 2) + F.pow(F.col("_py1") - F.col("_py2"), 2))
        met = a.withColumns({"_i": cell(F.col("_px1")), "_j": cell(F.col("_py1"))}).join(asks.hint("merge"), ["_m", "_i", "_j"])
        pairs = met.withColumn("_d", apart).where(F.col("_d") <= distance)
    if axis is None or axis <= 0:
        rank = F.col("_d")
    else:
        pairs = pairs.withColumn("_z", _up()).where(F.col("_z") > math.cos(math.radians(axis)))
        rank = -F.round("_z", 9)
    best = pairs.groupBy("uid2").agg(F.min(F.struct(rank.alias("rank"), "uid1", "_one", "_other")).alias("_b"))
    return best.select("_b.uid1", "uid2", "_b._one", "_b._other")


def correspondence(one: DataFrame, other: DataFrame, pose: str, distance: float | None = None, axis: float | None = None, micrograph: str = "mic", x: str = "x", y: str = "y", uid: str = "uid") -> DataFrame:
    """(uid1, uid2): for each row of other its partner in one.

    Where the tables share any uid, partners have one uid. Else they lie in one micrograph
    at most distance apart, in cells of that width. With axis (degrees), the axis of the
    turn from partner to row must be at most so far from +z, and of several candidates
    the one nearest to it is taken; without, the nearest in place. Ties go to the
    smaller uid.
    """
    return _matched(one, other, pose, distance, axis, micrograph, x, y, uid).select("uid1", "uid2")


def reassigned(one: DataFrame, other: DataFrame, pose: str, first: int, second: int, distance: float | None = None, axis: float | None = None, uid: str = "uid", **places: str) -> tuple[DataFrame, DataFrame, float | None]:
    """(rows of one, rows of other, relative angle): matched particles of refinements under Cn symmetries, with poses turned by whole steps of their symmetry so that those of a pair agree in one setting.

    Both tables keep all their columns and get pair, the uid of other's row; a row of one
    that several rows match comes back for each. Without a match both are empty and the
    angle is None.
    """
    written = Written(one.sparkSession)
    places = {"micrograph": "mic", "x": "x", "y": "y"} | places
    rows = written.keep(_matched(one, other, pose, distance, axis, uid=uid, **places))  # two ids and two angles a match, read by several jobs
    angle = relative_angle(rows, "_one", "_other", first, second, "uid2")
    if angle is None:
        written.close()
        empty = lambda df: df.withColumn("pair", F.col(uid)).limit(0)
        return empty(one), empty(other), None
    moved = unfolded(rows.withColumns({"_one0": F.col("_one"), "_other0": F.col("_other")}), "_one", "_other", first, second, angle)
    steps = written.keep(moved.select("uid1", "uid2", *[(F.col(c) - F.col(f"{c}0")).alias(c) for c in ("_one", "_other")]))
    written.close(steps)

    def out(df: DataFrame, u: str, name: str) -> DataFrame:
        step = steps.select(F.col(u).alias("_uid"), F.col("uid2").alias("pair"), F.col(name).alias("_step"))
        return turned(df.join(step.hint("merge"), F.col(uid) == F.col("_uid")), pose, F.col("_step")).drop("_uid", "_step")

    return out(one, "uid1", "_one"), out(other, "uid2", "_other"), angle
