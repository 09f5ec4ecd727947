"""Optics and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name patterns of acquisition software in the order in which they are tried, and the numbers of
# their groups for the time stamp, the serial number and the beam shift label (0: none).
SOFTWARE = {
    "EPU_old": (r"FoilHole_\d{7,8}_Data_\d{6,8}_\d{6,8}_(\d{8}_\d{6})_", 1, 0, 0),
    "EPU": (r"FoilHole_\d{7,8}_Data_\d{7,8}_(\d{1,3})_(\d{8}_\d{6})_", 2, 0, 1),
    "serialEM_pncc": (r"_(\d{3})_([XY][\+-]\d[XY][\+-]\d-\d)", 0, 1, 2),
    "serialEM_embl_heidelberg": (r"\d{6}_.{6}_(\d{5})_\d-(\d{1,2})[_\.]", 0, 1, 2),
    "serialEM_cuhksz": (r"_(\d{5})[_\.]", 0, 1, 0),
}


def electron_wavelength(kilovolts: Column) -> Column:
    """Relativistic wavelength in angstrom."""
    volts = kilovolts * 1000.0
    return 12.2639 / F.sqrt(volts + 0.97845e-6 * volts * volts)


def defocus_to_mean(u: Column, v: Column, angle: Column) -> tuple[Column, Column, Column]:
    """(mean defocus in micrometres, astigmatism, its angle) of two defocus values in angstrom."""
    return (u + v) / 2e4, F.abs(u - v) / 1e4, F.pmod(F.when(u > v, angle).otherwise(angle + 90.0), F.lit(180.0))


def defocus_from_mean(mean: Column, differ: Column, angle: Column) -> tuple[Column, Column, Column]:
    return mean * 1e4 + differ * 5e3, mean * 1e4 - differ * 5e3, angle


def image_index(name: Column) -> Column:
    return F.split_part(name, F.lit("@"), F.lit(1)).cast("long")


def image_file(name: Column) -> Column:
    return F.element_at(F.split(name, "@"), -1)


def image_name(index: Column, file: Column) -> Column:
    return F.format_string("%06d@%s", index, file)


def acquisition_epoch(name: Column) -> Column:
    """Unix seconds of the yyyyMMdd_HHmmss in a file name (UTC); null without one."""
    stamp = F.regexp_extract(name, r"(\d{8}_\d{6})", 1)
    return F.when(stamp != "", F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))))


def _of_software(name: Column, software: str | None, pick) -> Column:
    """pick(pattern and its groups) of one software, or of that which the name tells."""
    if software is not None:
        return pick(SOFTWARE[software])
    out = F.lit(None)
    for spec in reversed(SOFTWARE.values()):
        out = F.when(name.rlike(spec[0]), pick(spec)).otherwise(out)
    return out


def _group(name: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null without a match, or where the pattern has no such group."""
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, group)) if group else F.lit(None).cast("string")


def software_of(name: Column) -> Column:
    """The acquisition software that a file name tells; null for none."""
    out = F.lit(None).cast("string")
    for software, spec in reversed(SOFTWARE.items()):
        out = F.when(name.rlike(spec[0]), F.lit(software)).otherwise(out)
    return out


def is_of_software(name: Column, software: str) -> Column:
    return name.rlike(SOFTWARE[software][0])


def beam_shift_label(name: Column, software: str | None = None) -> Column:
    """The beam shift label in a file name, else its serial number, else null."""
    return _of_software(name, software, lambda spec: _group(name, spec[0], spec[3] or spec[2]))


def acquisition_time(name: Column, software: str | None = None) -> Column:
    """Unix seconds (UTC) of the time stamp in a file name, else its serial number, else infinity."""

    def pick(spec) -> Column:
        stamp, serial = _group(name, spec[0], spec[1]), _group(name, spec[0], spec[2])
        return F.coalesce(F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))).cast("double"), serial.cast("double"))

    return F.coalesce(_of_software(name, software, pick), F.lit(float("inf")))


def time_text(seconds: Column) -> Column:
    """yyyy-MM-dd_HH-mm-ss in the session's time zone, or "unknown"."""
    return F.when(seconds < float("inf"), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd_HH-mm-ss")).otherwise("unknown")


def eman_astigmatism(mean: Column, differ: Column, angle: Column) -> tuple[Column, Column, Column]:
    """(U, V, angle) in angstrom of a mean defocus and astigmatism in micrometres."""
    return defocus_from_mean(mean, differ, angle)


def file_stem(path: Column) -> Column:
    """The base name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def clean_micrograph(path: Column) -> Column:
    """Base name without a leading number of more than ten digits and without the suffixes of motion correction."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.regexp_replace(base, r"^\d{11,}_", ""), "_patch_aligned_doseweighted", "")
