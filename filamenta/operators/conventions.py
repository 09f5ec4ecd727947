"""From the columns of structured exports (blob/path, ctf/df1_A, ...) to STAR columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import quaternion_to_euler
from ..functions.optics import image_name
from .ranking import numbered

#: Columns that only change their name; of several with one new name the last wins.
RENAMED = {
    "micrograph_blob/path": "rlnMicrographName",
    "location/micrograph_path": "rlnMicrographName",
    "movie_blob/path": "rlnMicrographMovieName",
    "ctf/accel_kv": "rlnVoltage",
    "ctf/cs_mm": "rlnSphericalAberration",
    "ctf/amp_contrast": "rlnAmplitudeContrast",
    "ctf/ctf_fit_to_A": "rlnCtfMaxResolution",
    "blob/psize_A": "rlnImagePixelSize",
    "micrograph_blob/psize_A": "rlnMicrographPixelSize",
    "alignments3D/cross_cor": "rlnLogLikeliContribution",
    "ctf/bfactor": "rlnCtfBfactor",
    "ctf/scale": "rlnCtfScalefactor",
}
#: Numbers that count from 0 there and from 1 here.
FROM_ONE = {"alignments3D/split": "rlnRandomSubset", "alignments2D/class": "rlnClassNumber", "alignments3D/class": "rlnClassNumber"}
#: Columns of the exposure group, in order of preference.
EXPOSURE = ("ctf/exp_group_id", "location/exp_group_id", "mscope_params/exp_group_id")


def rotation_vector_to_euler(vector: Column) -> tuple[Column, Column, Column]:
    """(rot, tilt, psi) of an array column with axis times angle in radians."""
    x, y, z = (F.get(vector, k).cast("double") for k in range(3))
    angle = F.sqrt(x * x + y * y + z * z)
    part = F.when(angle < 1e-12, F.lit(0.5)).otherwise(F.sin(angle / 2) / angle)
    return quaternion_to_euler(F.cos(angle / 2), x * part, y * part, z * part)


def convention(df: DataFrame) -> str:
    """star, export or unknown, by the names of columns."""
    if any(c.startswith("rln") for c in df.columns):
        return "star"
    return "export" if any(c.split("/")[0] in ("blob", "ctf", "location", "alignments2D", "alignments3D", "filament", "micrograph_blob") for c in df.columns if "/" in c) else "unknown"


def _tubes(df: DataFrame) -> DataFrame:
    """df with _tube and, where positions are known, _track.

    Large ids become 1, 2, ... in each stack; ranks are taken over distinct ids and minima by aggregation, so a hot stack isn't one task.
    """
    if "filament/filament_uid" not in df.columns:
        return df
    uid = F.col("`filament/filament_uid`")
    if "blob/path" not in df.columns:
        ids = numbered(df.select(uid.alias("_uid")).distinct(), ["_uid"], "_tube")
        return df.join(ids, uid == F.col("_uid"), "left").drop("_uid")
    stack = F.col("`blob/path`")
    low = df.agg(F.min(uid)).first()[0]
    if low is not None and low > 1000:
        ids = df.select(stack.alias("_stack"), uid.alias("_uid")).distinct().withColumn("_tube", F.dense_rank().over(Window.partitionBy("_stack").orderBy("_uid")))
        df = df.join(ids, (stack == F.col("_stack")) & (uid == F.col("_uid")), "left").drop("_stack", "_uid")
    else:
        df = df.withColumn("_tube", uid.cast("int"))
    if "filament/position_A" in df.columns:
        at = F.col("`filament/position_A`").cast("double")
        first = df.groupBy(stack.alias("_stack"), uid.alias("_uid")).agg(F.min(at).alias("_from"))
        df = df.join(first, (stack == F.col("_stack")) & (uid == F.col("_uid")), "left").withColumn("_track", F.round(at - F.col("_from"), 2)).drop("_stack", "_uid", "_from")
    return df


def to_star(df: DataFrame, rid: str = "rid") -> DataFrame:
    """The table with STAR columns, for each that df can tell, and its row id; one that has them already comes back as it is.

    Angles become degrees, shifts become angstrom with the sign of the target, places
    become pixels from the top left; no axis is inverted. Nulls stay null.
    """
    if convention(df) == "star":
        return df
    if convention(df) != "export":
        raise ValueError(f"columns of no known convention: {df.columns}")
    df = _tubes(df)
    has = lambda *names: all(n in df.columns for n in names)
    c = lambda name: F.col(f"`{name}`")
    out: dict[str, Column] = {}
    if has("blob/idx", "blob/path"):
        out["rlnImageName"] = image_name(c("blob/idx").cast("long") + 1, c("blob/path"))
    out |= {new: c(old) for old, new in RENAMED.items() if has(old)}
    out |= {new: c(old).cast("int") + 1 for old, new in FROM_ONE.items() if has(old)}
    if has("ctf/df1_A", "ctf/df2_A", "ctf/df_angle_rad"):
        out |= {"rlnDefocusU": c("ctf/df1_A"), "rlnDefocusV": c("ctf/df2_A"), "rlnDefocusAngle": F.degrees(c("ctf/df_angle_rad"))}
    if has("ctf/phase_shift_rad"):
        out["rlnPhaseShift"] = F.degrees(c("ctf/phase_shift_rad"))
    if has("alignments2D/pose"):
        out["rlnAnglePsi"] = -F.round(F.degrees(c("alignments2D/pose")), 2)
    if has("alignments3D/pose"):
        out["rlnAngleRot"], out["rlnAngleTilt"], out["rlnAnglePsi"] = rotation_vector_to_euler(c("alignments3D/pose"))
    sign, shift = (1, "alignments3D/shift") if has("alignments3D/shift") else (-1, "alignments2D/shift")
    if has(shift, "blob/psize_A"):
        for k, axis in enumerate("XY"):
            out[f"rlnOrigin{axis}Angst"] = F.round(sign * F.round(F.get(c(shift), k), 2) * c("blob/psize_A"), 6)
    shape = next((s for s in ("location/micrograph_shape", "micrograph_blob/shape") if has(s)), None)
    if shape and has("location/center_x_frac", "location/center_y_frac"):
        out["rlnCoordinateX"] = F.round((c("location/center_x_frac") * F.get(c(shape), 1)).cast("double"), 2)
        out["rlnCoordinateY"] = F.round((c("location/center_y_frac") * F.get(c(shape), 0)).cast("double"), 2)
    if has("_tube"):
        out["rlnHelicalTubeID"] = c("_tube")
    if has("_track"):
        out["rlnHelicalTrackLengthAngst"] = c("_track")
    if has("filament/filament_pose"):
        out |= {"rlnAngleRotPrior": F.lit(0.0), "rlnAngleTiltPrior": F.lit(90.0), "rlnAnglePsiPrior": F.round(-F.degrees(c("filament/filament_pose")), 1), "rlnAnglePsiFlipRatio": F.lit(0.5)}
    if has("ctf/tilt_A", "ctf/cs_mm"):
        for k, axis in enumerate("XY"):
            out[f"rlnBeamTilt{axis}"] = F.round(F.asin(F.get(c("ctf/tilt_A"), k) / c("ctf/cs_mm") * 1e-7) * 1e3, 8)
    if has("ctf/anisomag"):
        out |= {f"rlnMagMat{k // 2}{k % 2}": F.get(c("ctf/anisomag"), k) for k in range(4)}
    exposure = next((e for e in EXPOSURE if has(e)), None)
    if exposure:
        out["rlnOpticsGroup"] = c(exposure).cast("int")
    for name in df.columns:
        if name.startswith("components_mode_") and name.endswith("/value"):
            out[f"v3d{name.split('/')[0].rsplit('_', 1)[-1]}"] = c(name)
    if not out:
        raise ValueError(f"none of these columns is known: {df.columns}")
    return df.select(*([rid] if has(rid) else []), *[value.alias(name) for name, value in out.items()])


#: Columns of an export that are laid over the STAR rows which it was imported from, and their factors.
OVERLAY = {"ctf/df1_A": ("rlnDefocusU", 1.0), "ctf/df2_A": ("rlnDefocusV", 1.0), "ctf/df_angle_rad": ("rlnDefocusAngle", 180.0 / math.pi), "ctf/phase_shift_rad": ("rlnPhaseShift", 1.0), "ctf/bfactor": ("rlnCtfBfactor", 1.0), "ctf/scale": ("rlnCtfScalefactor", 1.0)}


def laid_over(star: DataFrame, imported: DataFrame, chosen: DataFrame, rid: str = "rid", uid: str = "uid") -> DataFrame:
    """The STAR rows that an export still holds, with its class, 2D alignment and CTF in place of theirs.

    star and imported (rid, uid) count the same rows by rid; chosen is the export.
    """
    c = lambda name: F.col(f"`{name}`")
    has = set(chosen.columns)
    new: dict[str, Column] = {}
    if "alignments2D/class" in has:
        new["rlnClassNumber"] = c("alignments2D/class").cast("long") + 1
    if "alignments2D/shift" in has:
        size = c("blob/psize_A").cast("double") if "blob/psize_A" in has else F.lit(1.0)
        new |= {f"rlnOrigin{axis}Angst": -F.coalesce(F.get(c("alignments2D/shift"), k).cast("double"), F.lit(0.0)) * size for k, axis in enumerate("XY")}
    if "alignments2D/pose" in has:
        new["rlnAnglePsi"] = -c("alignments2D/pose").cast("double") * (180.0 / math.pi)
    new |= {name: c(source).cast("double") * factor for source, (name, factor) in OVERLAY.items() if source in has}
    over = chosen.select(F.col(uid).alias("_uid"), F.struct(F.lit(1).alias("_"), *[value.alias(name) for name, value in new.items()]).alias("_o"))
    rows = star.join(imported.select(rid, F.col(uid).alias("_uid")), rid).join(over, "_uid")
    return rows.select(*[F.col(f"`{n}`") for n in star.columns if n not in new], *[F.col(f"_o.{n}").alias(n) for n in new])
