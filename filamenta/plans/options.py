"""Options by name, so that chains of them run in the order given, each on what the one before left."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import optics as O
from ..functions import paths as T
from ..operators import columns as C
from ..operators import filaments as L
from ..operators import grouping as G
from ..operators import joins as J
from ..operators import selection as S

OPTIONS: dict[str, Callable[..., DataFrame]] = {}


def option(name: str) -> Callable:
    """Registers a function of (rows, words of its argument) under the name of an option."""

    def add(f: Callable) -> Callable:
        if name in OPTIONS:
            raise ValueError(f"there is an option {name} already")
        OPTIONS[name] = f
        return f

    return add


def run_options(df: DataFrame, chain: list[tuple[str, str]]) -> DataFrame:
    """The rows after a chain of (option, argument); an option may come again."""
    for name, argument in chain:
        if name not in OPTIONS:
            raise ValueError(f"no option {name}: there are {', '.join(sorted(OPTIONS))}")
        df = OPTIONS[name](df, *argument.split())
    return df


option("addParm")(lambda d, column, x: C.add(d, column, float(x)))
option("multParm")(lambda d, column, x: C.multiply(d, column, float(x)))
option("setParm")(C.set_value)
option("duplicateParm")(lambda d, *names: C.duplicate(d, dict(zip(names[::2], names[1::2]))))
option("renameParm")(lambda d, *names: C.rename(d, dict(zip(names[::2], names[1::2]))))
option("delParm")(C.delete)
option("keepParm")(C.keep_only)
option("replaceStr")(C.replace_text)
option("select")(lambda d, column, *values: S.is_in(d, column, [C.typed(v) for v in values]))
option("selectValueRange")(lambda d, column, low, high: S.between_open(d, column, float(low), float(high)))
option("selectRatioRange")(lambda d, column, low, high: S.ratio_range(d, column, float(low), float(high)))
option("first")(lambda d, n: S.rows_between(d, "rid", 0, int(n)))
option("minDuplicates")(lambda d, column, n: S.min_duplicates(d, column, int(n), "rid"))
option("removeDuplicates")(lambda d, *columns: S.first_of(d, list(columns), "rid"))
option("keepOneParticlePerMicrograph")(lambda d: S.one_per_group(d, ["mic"], "rid"))
option("keepOneParticlePerHelicalTube")(lambda d: S.one_per_group(d, ["mic", "tube"], "rid"))
option("randomSample")(lambda d, group, n: S.random_sample(d, group, int(n), "rid"))
option("sets")(lambda d, n, k: S.stride(d, "rid", int(n), int(k)))
option("sortby")(lambda d, *columns: d.orderBy(*C.sort_keys(d, list(columns), "image")))
option("rsortby")(lambda d, *columns: d.orderBy(*C.sort_keys(d, list(columns), "image", descending=True)))
option("breakFilaments")(lambda d, most: L.break_filaments(d, int(most)))
option("assignOpticGroupPerMicrograph")(lambda d, column: G.first_seen_ids(d, [column], "rid", "optics_group"))
option("resetOpticGroup")(lambda d: G.reset(d, "optics_group"))
option("last")(lambda d, n: d.orderBy(F.desc("rid")).limit(int(n)))
option("psiPrior180")(lambda d: S.with_opposite(d, "psi", "mic"))
option("replaceImageName")(lambda d, file: d.withColumn("image", O.image_name(F.col("rid"), F.lit(file))))
option("setBeamTiltClass")(lambda d, name="tilt_class": G.first_seen_ids(d.withColumn("_file", O.image_file(F.col("image"))), ["_file"], "rid", name).drop("_file"))
option("estimateHelicalTubeLength")(lambda d, name="tube_length": d.join(L.tube_lengths(d).select(*L.KEYS, F.col("longest").alias(name)), L.KEYS, "left"))
option("estimateHelicalAngleVariance")(lambda d: L.with_angle_sigmas(d))
option("resetInterSegmentDistance")(lambda d, spacing: L.resampled_rows(d, float(spacing)))
option("normEulerDist")(lambda d, step, n: S.best_per_bin(d.withColumn("_a", F.floor(F.col("rot") / float(step))).withColumn("_b", F.floor(F.col("tilt") / float(step))), ["_a", "_b"], "score", int(n), "rid").drop("_a", "_b"))
option("splitByMicrograph")(lambda d, sets=2: S.split_largest_first(d, ["mic"], "rid", int(sets)))
option("splitNumSets")(lambda d, sets: S.split_even_odd(d, "rid", int(sets)))
option("changePixelSize")(lambda d, x: C.change_pixel_size(d, float(x)))
option("path")(lambda d, to, base="/": T.converted(d, "image", to, base, base))
option("extractHelices")(lambda d, n: d.join(L.tube_lengths(d).orderBy(F.desc("span"), *L.KEYS).limit(int(n)).select(*L.KEYS), L.KEYS, "left_semi"))
option("assignExposureGroupPerMicrograph")(lambda d, name="exp_group": G.sorted_ids(d, ["mic"], name))
option("assignExposureGroupByTime")(lambda d, size, parent="tube", name="exp_group": G.time_groups(d, parent, "track", int(size), name))
option("resetExposureGroups")(lambda d, name="exp_group": G.reset(d, name))


@dataclass(frozen=True)
class Tables:
    """What a chain with optics works on: rows, their optics table, and other tables by the names under which options ask for them."""

    rows: DataFrame
    optics: DataFrame | None = None
    others: Mapping[str, "Tables"] = field(default_factory=dict)
    group: str = "rlnOpticsGroup"

    def other(self, name: str) -> "Tables":
        if name not in self.others:
            raise ValueError(f"no table {name}: there are {', '.join(sorted(self.others))}")
        return self.others[name]

    def needed_optics(self) -> DataFrame:
        if self.optics is None:
            raise ValueError("this option needs an optics table")
        return self.optics


PAIRED: dict[str, Callable[..., Tables]] = {}


def paired(name: str) -> Callable:
    """Registers a function of (tables, words of its argument); it goes before one of OPTIONS where there is an optics table or no other."""

    def add(f: Callable) -> Callable:
        if name in PAIRED:
            raise ValueError(f"there is an option {name} already")
        PAIRED[name] = f
        return f

    return add


def run_with_optics(tables: Tables, chain: list[tuple[str, str]]) -> Tables:
    """The tables after a chain of (option, argument): options on rows leave optics alone, those on optics change both.

    Where there is no optics table, an option of both kinds works on the rows alone.
    """
    for name, argument in chain:
        words = argument.split()
        if name in PAIRED and (tables.optics is not None or name not in OPTIONS):
            tables = PAIRED[name](tables, *words)
        elif name in OPTIONS:
            tables = replace(tables, rows=OPTIONS[name](tables.rows, *words))
        else:
            raise ValueError(f"no option {name}: there are {', '.join(sorted({*OPTIONS, *PAIRED}))}")
    return tables


def _both(t: Tables, pair: tuple[DataFrame, DataFrame | None]) -> Tables:
    return replace(t, rows=pair[0], optics=pair[1])


def _rows(t: Tables, rows: DataFrame) -> Tables:
    return replace(t, rows=rows)


def _used(t: Tables) -> Tables:
    """Without optics rows that no row has any more."""
    if t.optics is None:
        return t
    return replace(t, optics=t.optics.join(t.rows.select(t.group), t.group, "left_semi"))


def _others(t: Tables, source: DataFrame, columns: tuple[str, ...], kept: tuple[str, ...]) -> list[str]:
    """The columns to copy: those named, or all that source has; less those after a ~ and the kept ones."""
    asked = [c for c in columns if not c.startswith("~")] or source.columns
    less = {*kept, *(c[1:] for c in columns if c.startswith("~"))}
    return [c for c in asked if c in source.columns and c not in less]


paired("setParm")(lambda t, column, value: _both(t, C.set_optics_value(t.rows, t.optics, column, value)))
paired("apix")(lambda t, x: _both(t, C.set_pixel_size(t.rows, t.optics, float(x))))
paired("assignOpticGroupByTime")(lambda t, size, software=None: _both(t, G.optics_by_time(t.rows, t.needed_optics(), "image", int(size), t.group, software)))
paired("assignOpticGroupPerMicrograph")(lambda t, column="image": _both(t, G.optics_per_micrograph(t.rows, t.needed_optics(), column, "rid", t.group)))
paired("assignOpticGroupByBeamShiftLabel")(lambda t, software, shifts=1: _both(t, G.optics_by_label(t.rows, t.needed_optics(), "image", software, t.group, int(shifts))))
paired("assignOpticGroupByBeamShiftXY")(lambda t, least=4: _both(t, G.optics_by_shift(t.rows, t.needed_optics(), "image", "shift_x", "shift_y", t.group, int(least))))
paired("resetOpticGroup")(lambda t: _both(t, G.one_optics_group(t.rows, t.needed_optics(), t.group)))
paired("dissolveOptics")(lambda t: _both(t, (G.dissolve_optics(t.rows, t.needed_optics(), t.group), None)))
paired("usedOptics")(_used)
paired("copyOptics")(lambda t, name, *columns: replace(t, optics=J.copy_optics(t.needed_optics(), t.other(name).needed_optics(), *([columns] if columns else []), group=t.group)))
paired("copyParm")(lambda t, name, *columns: _rows(t, J.last_lookup(t.rows, t.other(name).rows, "image", _others(t, t.other(name).rows, columns, ("image", "rid")), "rid")))
paired("copyCtf")(lambda t, name: _rows(t, J.mean_ctf_lookup(t.rows, t.other(name).rows, "mic", "defocus_u", "defocus_v", "defocus_angle")))
paired("setCTF")(lambda t, name: _rows(t, J.set_ctf(t.rows, t.other(name).rows, "image")))
paired("selectFile")(lambda t, name, one="image", other="image", pattern=None: _rows(t, J.select_by_name(t.rows, t.other(name).rows, one, other, pattern)))
paired("excludeFile")(lambda t, name, one="image", other="image", pattern=None: _rows(t, J.select_by_name(t.rows, t.other(name).rows, one, other, pattern, keep=False)))
paired("selectCommonHelices")(lambda t, name: _rows(t, J.semi(t.rows, t.other(name).rows, L.KEYS)))
paired("selectByParticleLocation")(lambda t, name, distance: _rows(t, J.near_semi(t.rows, t.other(name).rows, ["mic"], "x", "y", float(distance), "rid")))
paired("recoverFullFilaments")(lambda t, name, least=None: _rows(t, J.recover_filaments(t.rows, t.other(name).rows, L.KEYS, least and float(least))))
paired("fullStack")(lambda t, name: _rows(t, C.full_stack(t.rows, t.other(name).rows, "image")))
paired("showTime")(lambda t, name, column: _rows(t, C.with_created_time(t.rows, t.other(name).rows, column)))
paired("micrographStar")(lambda t, name: _rows(t, J.remapped_micrographs(t.rows, t.other(name).rows)))
paired("copyExposureGroupAssignments")(lambda t, name, group="exp_group": _rows(t, J.last_lookup(t.rows, t.other(name).rows, "mic", [group], "rid")))
paired("copyExposureGroupParameters")(lambda t, name, group, *columns: _rows(t, J.exposure_parameters(t.rows, t.other(name).rows, "image", group, list(columns))))
paired("assignExposureGroupByBeamShiftLabel")(lambda t, software, name="exp_group": _rows(t, G.label_groups(t.rows, "image", software, name, parent="tube")))
paired("assignExposureGroupByBeamShiftXY")(lambda t, least, *medians: _rows(t, G.exposure_groups_by_shift(t.rows, "exp_group", "image", "shift_x", "shift_y", list(medians), "exp_group", int(least))))
