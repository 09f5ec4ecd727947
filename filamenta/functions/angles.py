"""Angles and rotations as Catalyst expressions (degrees unless a name says otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(angle: Column, period: float = 360.0) -> Column:
    """angle moved into [-period/2, period/2)."""
    half = period / 2
    return F.pmod(angle + half, F.lit(period)) - half


def angular_difference(a: Column, b: Column, period: float = 360.0) -> Column:
    return wrap(a - b, period)


def angle_in_range(angle: Column, low: float, high: float) -> Column:
    """angle moved by whole periods of high - low into [low, high)."""
    return F.pmod(angle - low, F.lit(high - low)) + low


def circular_mean(angle: Column) -> Column:
    """Aggregate: the mean direction in [0, 360)."""
    r = F.radians(angle)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def circular_std(angle: Column) -> Column:
    """Aggregate: sqrt(-2 ln R) in degrees; 0 where all directions agree."""
    r = F.radians(angle)
    length = F.least(F.lit(1.0), F.sqrt(F.pow(F.avg(F.sin(r)), 2) + F.pow(F.avg(F.cos(r)), 2)))
    return F.degrees(F.sqrt(-2 * F.ln(length)))


def euler_to_quaternion(rot: Column, tilt: Column, psi: Column) -> tuple[Column, Column, Column, Column]:
    """Scalar-first quaternion of the ZYZ rotation."""
    a, b, c = (F.radians(x) / 2 for x in (rot, tilt, psi))
    return F.cos(b) * F.cos(a + c), F.sin(b) * F.sin(c - a), F.sin(b) * F.cos(c - a), F.cos(b) * F.sin(a + c)


def quaternion_to_euler(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(rot, tilt, psi) of a scalar-first unit quaternion; at tilt 0 all of the turn is rot."""
    tilt = 2 * F.atan2(F.sqrt(x * x + y * y), F.sqrt(w * w + z * z))
    total, differ = F.atan2(z, w), F.atan2(x, y)
    flat = (F.abs(x) < 1e-12) & (F.abs(y) < 1e-12)
    rot = F.when(flat, 2 * total).otherwise(total - differ)
    psi = F.when(flat, F.lit(0.0)).otherwise(total + differ)
    return wrap(F.degrees(rot)), F.degrees(tilt), wrap(F.degrees(psi))


def geodesic_distance(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Degrees between two unit quaternions."""
    dot = sum((a * b for a, b in zip(p, q)), F.lit(0.0))
    return 2 * F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot))))


def twist_to_pitch(twist: Column, rise: Column) -> Column:
    """Pitch of a helix; 0 for no twist."""
    return F.when(twist == 0, F.lit(0.0)).otherwise(F.abs(360.0 / twist) * rise)


def twist_to_pitch_near_strand(twist: Column, rise: Column) -> Column:
    """Pitch after the most subunits, ten at most, whose joint rise lies between 4.5 and 5 and whose joint twist stays under 90; of one subunit if there are none."""
    pitch = F.abs(rise) * 360.0 / F.abs(twist)
    for n in range(2, 11):
        joint = F.abs(wrap(F.abs(twist) * n))
        pitch = F.when((rise * n > 4.5) & (rise * n < 5) & (joint < 90), F.abs(rise) * n * 360.0 / joint).otherwise(pitch)
    return pitch


def fit_error(angle: Column, at: Column, slope: float, intercept: float, period: float = 360.0) -> Column:
    """Signed distance of an angle from a line modulo its period."""
    return wrap(angle - (at * slope + intercept), period)


def cosine_similarity(a: str, b: str) -> Column:
    """Of two array columns; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
