"""Rotational point groups as unit quaternions, and distances up to symmetry as Catalyst expressions.

A group has at most 2n (C, D), 12, 24 or 60 elements, so it is a literal of the plan.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Quaternion = tuple[float, float, float, float]

_PHI = (1 + math.sqrt(5)) / 2
#: Generators of the groups without a number, as (axis, turns).
_GENERATORS = {
    "T": [((1, 1, 1), 1 / 3), ((0, 0, 1), 1 / 2)],
    "O": [((0, 0, 1), 1 / 4), ((1, 1, 1), 1 / 3)],
    "I": [((0, 0, 1), 1 / 2), ((1, 0, 0), 1 / 2), ((0, 1, _PHI), 1 / 5)],
}
#: Turns, last one first, from the setting with twofold axes along x, y, z and a fivefold one in the yz plane.
_SETTINGS = {
    "_2z2x5y": [],
    "_2z2x5x": [((0, 0, 1), 1 / 4)],
    "_5z2x": [((1, 0, 0), math.atan(1 / _PHI) / math.tau)],
    "_5z2y": [((0, 1, 0), -math.atan(_PHI) / math.tau)],
    "_3z2x": [((1, 0, 0), math.atan(_PHI**2) / math.tau)],
    "_3z2y": [((0, 0, 1), 1 / 4), ((1, 0, 0), math.atan(_PHI**2) / math.tau)],
}
#: Other names of settings.
_ALIASES = {"I1": "_2z2x5y", "I2": "_2z2x5x", "I3": "_5z2y", "I4": "_5z2x", "I": "_5z2x"}


def product(p: Quaternion, q: Quaternion) -> Quaternion:
    """The rotation q followed by p; works on numbers and on Columns."""
    a, b, c, d = p
    e, f, g, h = q
    return a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e


def inverse(q: Quaternion) -> Quaternion:
    return q[0], -q[1], -q[2], -q[3]


def turn(axis: tuple[float, float, float], turns: float) -> Quaternion:
    length = math.sqrt(sum(x * x for x in axis))
    s = math.sin(math.pi * turns) / length
    return math.cos(math.pi * turns), axis[0] * s, axis[1] * s, axis[2] * s


def _setting(symbol: str) -> Quaternion:
    suffix = _ALIASES.get(symbol.upper()) or re.sub(r"^I\d*", "", symbol, flags=re.IGNORECASE).lower()
    if suffix not in _SETTINGS:
        raise ValueError(f"no icosahedral setting {symbol}")
    out: Quaternion = (1.0, 0.0, 0.0, 0.0)
    for step in _SETTINGS[suffix]:
        out = product(out, turn(*step))
    return out


def setting_change(source: str, target: str) -> Quaternion:
    """The rotation from one icosahedral setting to another."""
    return product(_setting(target), inverse(_setting(source)))


def group(symbol: str) -> list[Quaternion]:
    """All rotations of a group (C4, D7, T, O, I, I1 .. I4, I_5z2x, ...), the identity first."""
    parts = re.fullmatch(r"([A-Za-z])(\d*)(_\w+)?", symbol)
    kind = parts.group(1).upper() if parts else ""
    if kind in ("C", "D"):
        n = int(parts.group(2) or 1)
        generators = [turn((0, 0, 1), 1 / n)] + ([turn((1, 0, 0), 1 / 2)] if kind == "D" else [])
    elif kind in _GENERATORS:
        generators = [turn(*g) for g in _GENERATORS[kind]]
        if kind == "I":
            to = _setting(symbol)
            generators = [product(product(to, g), inverse(to)) for g in generators]
    else:
        raise ValueError(f"no rotational group {symbol}")

    def named(q: Quaternion) -> tuple[int, ...]:
        """q and -q are one rotation."""
        name = tuple(round(x * 1e6) for x in q)
        return max(name, tuple(-x for x in name))

    found = {named((1.0, 0.0, 0.0, 0.0)): (1.0, 0.0, 0.0, 0.0)}
    edge = list(found.values())
    while edge:
        grown = {named(q): q for p in edge for g in generators for q in [product(p, g)]}
        edge = [q for name, q in grown.items() if name not in found]
        found |= {named(q): q for q in edge}
    return list(found.values())


def matrix(q: Quaternion) -> list[list[float]]:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def turned(q: Quaternion, point: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A point of three Columns, turned by a known rotation."""
    return tuple(sum((F.lit(m) * p for m, p in zip(row, point)), F.lit(0.0)) for row in matrix(q))


def symmetric_points(point: tuple[Column, Column, Column], symbol: str) -> Column:
    """An array of structs (op, x, y, z): the point under each rotation of the group, numbered from 0."""
    copies = []
    for k, q in enumerate(group(symbol)):
        x, y, z = turned(q, point)
        copies.append(F.struct(F.lit(k).alias("op"), x.alias("x"), y.alias("y"), z.alias("z")))
    return F.array(*copies)


def point_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], symbol: str) -> Column:
    """The least Euclidean distance of a to the copies of b."""
    copies = F.transform(symmetric_points(b, symbol), lambda c: F.sqrt(F.pow(a[0] - c["x"], 2) + F.pow(a[1] - c["y"], 2) + F.pow(a[2] - c["z"], 2)))
    return F.array_min(copies)


def set_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], symbol: str, metric: str = "mse") -> Column:
    """Aggregate: the least distance of corresponding points with all a turned by one rotation of the group; mse, rmse or max (of coordinates)."""
    found = []
    for q in group(symbol):
        apart = [p - r for p, r in zip(turned(q, a), b)]
        if metric == "max":
            found.append(F.max(F.greatest(*[F.abs(d) for d in apart])))
        elif metric in ("mse", "rmse"):
            found.append(F.avg(sum((d * d for d in apart), F.lit(0.0))))
        else:
            raise ValueError(f"no metric {metric}")
    best = F.array_min(F.array(*found))
    return F.sqrt(best) if metric == "rmse" else best


def rotation_distance(p: tuple[Column, ...], q: tuple[Column, ...], symbol: str, kind: str = "geodesic") -> Column:
    """The least distance of two rotations (quaternions of Columns), one of them followed by any of the group: degrees, or chordal (Frobenius norm of the matrices' difference)."""
    relative = product(q, inverse(p))
    dots = [F.abs(sum((F.lit(g) * r for g, r in zip(op, relative)), F.lit(0.0))) for op in group(symbol)]
    best = F.least(F.lit(1.0), F.array_max(F.array(*dots)))
    if kind == "chordal":
        return F.sqrt(8 * (1 - best * best))
    return 2 * F.degrees(F.acos(best))
