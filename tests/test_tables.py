"""Ranks, splits, fits, readers and writers against plain loops."""

import collections
import heapq
import itertools
import random
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from filamenta.functions import optics, paths
from filamenta.operators import columns, conventions, filaments, grouping, images, mismatch, ranking, selection
from filamenta.plans import options
from filamenta.sources import databases, exports, maps, star


def test_running_sums_and_order_statistics(spark):
    r = random.Random(1)
    rows = [(r.choice("abcdé"), k, r.randrange(50)) for k in range(3000)] + [(None, 3001, 7)]
    df = spark.createDataFrame(rows, "a string, k long, v long").repartition(5)
    want, total = {}, 0
    for a, k, v in sorted(rows, key=lambda x: ((x[0] is not None, x[0] or ""), x[1])):
        want[k], total = total, total + v
    for ranges in (3, 256):
        assert {x["k"]: x["s"] for x in ranking.running_before(df, ["a", "k"], F.col("v"), "s", ranges).collect()} == want
    values = sorted(v for _, _, v in rows)
    for k in (1, 2, 1500, 3001):
        assert ranking.kth_smallest(df, "v", k, 7) == values[k - 1]
    assert ranking.kth_smallest(df, "v", 3002) is None and ranking.kth_smallest(df.limit(0), "v", 1) is None
    many = [r.gauss(0, 1) for _ in range(2000)]
    d = spark.createDataFrame([(x,) for x in many], "v double")
    assert [ranking.kth_smallest(d, "v", k, 5) for k in (1, 700, 2000)] == [sorted(many)[k - 1] for k in (1, 700, 2000)]


def test_largest_first_deals_as_one_by_one(spark):
    r = random.Random(2)
    for _ in range(200):
        sizes, sets = [r.randint(1, 12) for _ in range(r.randint(1, 60))], r.randint(1, 5)
        held = [(0, k) for k in range(sets)]
        want = collections.defaultdict(list)
        for n in sorted(sizes, reverse=True):
            h, k = heapq.heappop(held)
            want[n].append(k)
            heapq.heappush(held, (h + n, k))
        got = collections.defaultdict(dict)
        for size, a, b, order in selection.dealt(collections.Counter(sizes), sets):
            got[size] |= {k: order[(k - a) % len(order)] for k in range(a, b)}
        assert {n: [got[n][k] for k in range(len(ks))] for n, ks in want.items()} == want
    rows = [(k, f"m{r.randrange(30)}") for k in range(500)]
    out = selection.split_in_halves(spark.createDataFrame(rows, "rid long, mic string"), ["mic"], "rid").collect()
    assert len(out) == 500 and len({(x["mic"], x["subset"]) for x in out}) == len({m for _, m in rows})
    assert abs(sum(1 if x["subset"] == 1 else -1 for x in out)) == 0


def test_halves_are_the_most_even_ones(spark):
    r = random.Random(3)
    for _ in range(6):
        sizes = [r.randint(1, 9) for _ in range(r.randint(1, 8))]
        rows = [(k, m) for k, m in enumerate(m for m, n in enumerate(sizes) for _ in range(n))]
        best = min(abs(sum(n if c else -n for n, c in zip(sizes, choice))) for choice in itertools.product((0, 1), repeat=len(sizes)))
        out = selection.split_in_halves(spark.createDataFrame(rows, "rid long, mic long"), ["mic"], "rid")
        assert abs(sum(1 if x["subset"] == 1 else -1 for x in out.collect())) == best


def test_runs_packed_by_tasks_are_those_packed_one_by_one(spark):
    r = random.Random(4)
    runs = {p: [(t, r.randint(1, 6)) for t in sorted(r.sample(range(1000), r.randint(1, 40)))] for p in range(12)}
    df = spark.createDataFrame([(p, float(t), n) for p, rs in runs.items() for t, n in rs], "p long, t double, n long").repartition(4)
    got = {(x["p"], x["t"]): x["group"] for x in grouping.packed_times(df, "p", "t", "n", 7).collect()}
    assert got == {(p, float(t)): g for p, rs in runs.items() for (t, _), g in zip(rs, grouping.packed_runs(rs, 7))}


def test_best_line_is_that_of_plain_loops(spark):
    r = random.Random(5)
    rows = []
    for mic in range(4):
        for k in range(30):
            rows.append((len(rows), mic, 4.0 * k, (17 + (0.3 - 0.2 * mic) * 4.0 * k + r.gauss(0, 5)) % 360))
    rows += [(900 + k, 9, float(k), 0.0) for k in range(24)]
    got = {x["mic"]: x for x in filaments.fit_slopes(spark.createDataFrame(rows, "rid long, mic long, track double, rot double"), ["mic"], slopes=45).collect()}
    assert set(got) == {0, 1, 2, 3}
    wrap = lambda d: (d + 180) % 360 - 180
    for mic, x in got.items():
        mine = [(t, o) for _, m, t, o in rows if m == mic]
        best = None
        for k in range(45):
            m = -1.1 + 2.2 * k / 44
            turned, last = [], None
            for t, o in mine:
                v = o - m * t
                last = v if last is None else last + wrap(v - last)
                turned.append(last)
            b = sum(turned) / len(turned)
            sse = sum(wrap(o - m * t - b) ** 2 for t, o in mine)
            if best is None or sse < best[0] - 1e-6:
                best = (sse, m, b)
        assert abs(x["slope"] - best[1]) < 1e-9 and abs(x["sse"] - best[0]) < 1e-6 and abs(wrap(x["intercept"] - best[2])) < 1e-6


def test_two_gaussians_are_found(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(3, 1, 3000), r.normal(12, 2, 1000)])
    (w1, m1, s1), (w2, m2, s2) = filaments.two_gaussians(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", 80)
    assert abs(w1 - 0.75) < 0.03 and abs(m1 - 3) < 0.2 and abs(m2 - 12) < 0.4 and abs(s1 - 1) < 0.2 and abs(s2 - 2) < 0.4
    assert filaments.two_gaussians(spark.createDataFrame([(2.0,)], "v double"), "v")[0] == (1.0, 2.0, 0.0)


def test_symmetry_mismatch_is_solved(spark):
    r = random.Random(6)
    rows = []
    for k in range(60):
        a = r.uniform(0, 360)
        rows.append((k, (a + 120 * r.randrange(3)) % 120, (a + 23 + r.gauss(0, 0.4)) % 90))
    df = spark.createDataFrame(rows, "rid long, one double, other double")
    angle = mismatch.relative_angle(df, "one", "other", 3, 4, "rid")
    assert mismatch.angle_range(3, 4) == 30.0 and abs(angle - 23) < 0.5
    for x in mismatch.unfolded(df, "one", "other", 3, 4, angle).collect():
        assert abs((x["other"] - x["one"] - angle + 180) % 360 - 180) < 3
    assert mismatch.relative_angle(df.limit(0), "one", "other", 3, 4, "rid") is None


def test_names_of_every_software(spark):
    names = ["FoilHole_1464933_Data_427288_427290_20250502_213110_Fractions.mrc", "FoilHole_28788144_Data_28764755_46_20240328_192116_fractions.tiff", "SAVED4M-DNA3_39-103_001_X+0Y+0-1.tif", "250123_SF0431_01129_1-7.eer", "k2_1219_cva6X_00087.tif", "nothing.tif"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    got = [tuple(x) for x in df.orderBy("k").select(optics.software_of(F.col("n")), optics.beam_shift_label(F.col("n")), optics.acquisition_time(F.col("n"))).collect()]
    assert [x[0] for x in got] == ["EPU_old", "EPU", "serialEM_pncc", "serialEM_embl_heidelberg", "serialEM_cuhksz", None]
    assert [x[1] for x in got] == [None, "46", "X+0Y+0-1", "7", "00087", None]
    assert [x[2] for x in got] == [1746221470.0, 1711653676.0, 1.0, 1129.0, 87.0, float("inf")]
    with pytest.raises(ValueError):
        grouping.label_groups(df, "n", "EPU_old", "g")


def test_star_with_optics_and_every_sink(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"{k + 1:06d}@a.mrcs", k % 2 + 1, k * 1.5, [1.0, k * 2.0]) for k in (3, 1, 0, 2)], "rid long, rlnImageName string, rlnOpticsGroup long, rlnAnglePsi double, v array<double>")
    table = spark.createDataFrame([(2, 200.0), (1, 300.0)], "rlnOpticsGroup long, rlnVoltage double")
    out = f"file://{tmp_path}"
    exports.write_table(rows, f"{out}/a.star", table)
    text = (tmp_path / "a.star").read_text()
    assert [b for b, _, _ in star.loops(text)] == ["optics", "particles"]
    back, own = star.read_star_tables(spark, f"{out}/a.star")
    assert [tuple(x) for x in back.orderBy("rid").select("rlnImageName", "rlnOpticsGroup", "rlnAnglePsi").collect()] == [(f"{k + 1:06d}@a.mrcs", k % 2 + 1, k * 1.5) for k in range(4)]
    assert {tuple(x) for x in own.select("rlnOpticsGroup", "rlnVoltage").collect()} == {(1, 300.0), (2, 200.0)}
    exports.write_table(rows, f"{out}/b.oldformat.star", table)
    flat, none = star.read_star_tables(spark, f"{out}/b.oldformat.star")
    assert none is None and {x["rlnVoltage"] for x in flat.collect()} == {200.0, 300.0}
    exports.write_table(rows, f"{out}/c.cs")
    data = np.load(tmp_path / "c.cs")
    assert sorted(data["rid"].tolist()) == [0, 1, 2, 3] and data["v"].shape == (4, 2) and data["rlnImageName"].dtype.kind == "S"
    got = exports.read_export(spark, f"{out}/c.cs").orderBy("rlnImageName").collect()
    assert [x["rlnAnglePsi"] for x in got] == [0.0, 1.5, 3.0, 4.5] and got[1]["v"] == [1.0, 2.0]
    exports.write_export(rows.repartition(2), f"{out}/parts")
    assert exports.read_export(spark, f"{out}/parts").count() == 4
    exports.write_table(rows.drop("v"), f"{out}/d.csv")
    exports.write_table(rows, f"{out}/e.parquet")
    star.write_star_by(rows.drop("v"), f"{out}/split", "rlnOpticsGroup")
    assert exports.read_tables(spark, [f"{out}/a.star", f"{out}/c.cs", f"{out}/d.csv", f"{out}/e.parquet"]).count() == 16
    assert len(list((tmp_path / "split").glob("rlnOpticsGroup=*"))) == 2
    for bad in (lambda: exports.write_table(rows.limit(0), f"{out}/f.star"), lambda: exports.write_table(rows, f"{out}/f.txt"), lambda: exports.read_tables(spark, ["x.txt"])):
        with pytest.raises(ValueError):
            bad()


def test_passthrough_is_found_beside_an_export(spark, tmp_path):
    np.save(open(tmp_path / "J5_particles.cs", "wb"), np.array([(1, 2.0), (2, 3.0)], [("uid", "u8"), ("a", "f4")]))
    np.save(open(tmp_path / "P1_J5_passthrough_particles.cs", "wb"), np.array([(2, 9.0, 5.0)], [("uid", "u8"), ("a", "f4"), ("b", "f4")]))
    got = exports.read_export(spark, f"file://{tmp_path}/J5_particles.cs", discover=True).orderBy("uid").collect()
    assert [(x["a"], x["b"]) for x in got] == [(2.0, None), (3.0, 5.0)]
    assert exports.passthrough_of(spark, f"file://{tmp_path}/none/particles_a.cs") is None


def test_export_is_laid_over_the_rows_it_came_from(spark):
    rows = spark.createDataFrame([(k, f"i{k}", 9, 1.0) for k in range(4)], "rid long, rlnImageName string, rlnClassNumber long, rlnDefocusU double")
    imported = spark.createDataFrame([(k, 100 + k) for k in range(4)], "rid long, uid long")
    chosen = spark.createDataFrame([(102, 4, [1.0, -2.0], 0.5, 7.0), (101, 0, [0.0, 3.0], 0.0, 8.0)], "uid long, `alignments2D/class` int, `alignments2D/shift` array<double>, `alignments2D/pose` double, `ctf/df1_A` double")
    got = {x["rlnImageName"]: x.asDict() for x in conventions.laid_over(rows, imported, chosen).collect()}
    assert set(got) == {"i1", "i2"} and got["i2"]["rlnClassNumber"] == 5 and got["i2"]["rlnOriginXAngst"] == -1.0 and got["i2"]["rlnOriginYAngst"] == 2.0
    assert abs(got["i2"]["rlnAnglePsi"] + 28.64788975654116) < 1e-9 and got["i1"]["rlnDefocusU"] == 8.0


def test_refinement_database(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.db")
    db.executescript("""
        CREATE TABLE REFINEMENT_LIST (REFINEMENT_ID INT, REFINEMENT_PACKAGE_ASSET_ID INT); INSERT INTO REFINEMENT_LIST VALUES (1, 3), (2, 3);
        CREATE TABLE REFINEMENT_PACKAGE_ASSETS (REFINEMENT_PACKAGE_ASSET_ID INT, STACK_FILENAME TEXT); INSERT INTO REFINEMENT_PACKAGE_ASSETS VALUES (3, '/d/s.mrc');
        CREATE TABLE IMAGE_ASSETS (IMAGE_ASSET_ID INT, FILENAME TEXT); INSERT INTO IMAGE_ASSETS VALUES (5, '/d/m5.mrc');
        CREATE TABLE REFINEMENT_PACKAGE_CONTAINED_PARTICLES_3 (POSITION_IN_STACK INT, PARENT_IMAGE_ASSET_ID INT, X_POSITION REAL, Y_POSITION REAL, PIXEL_SIZE REAL, DEFOCUS1 REAL); INSERT INTO REFINEMENT_PACKAGE_CONTAINED_PARTICLES_3 VALUES (1, 5, 10, 20, 2, 1), (2, -1, 30, 40, 2, 1);
        CREATE TABLE REFINEMENT_RESULT_2_1 (POSITION_IN_STACK INT, PSI REAL, XSHIFT REAL, YSHIFT REAL, DEFOCUS1 REAL, PHASE_SHIFT REAL); INSERT INTO REFINEMENT_RESULT_2_1 VALUES (1, 7, 4, -6, 100, 1.5707963), (2, 8, 0, 0, 200, 0);
    """)
    db.commit()
    db.close()
    a, b = databases.read_refinement(spark, f"file://{tmp_path}/a.db").orderBy("rid").collect()
    assert (a["rlnImageName"], a["rlnMicrographName"], a["rlnCoordinateX"], a["rlnOriginX"], a["rlnOriginY"], a["rlnDefocusU"], a["rlnPhaseShift"]) == ("000001@/d/s.mrc", "/d/m5.mrc", 5.0, -2.0, 3.0, 100.0, 90.0)
    assert b["rlnMicrographName"] is None and b["rlnAnglePsi"] == 8.0
    assert exports.read_tables(spark, [f"file://{tmp_path}/a.db"]).count() == 2


def test_map_headers_sections_and_beam_shifts(spark, tmp_path):
    data = np.arange(24, dtype="<f4").reshape(2, 3, 4)
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, 4, 3, 2, 2)
    struct.pack_into("<3i3f", head, 28, 4, 3, 2, 6.0, 4.5, 3.0)
    struct.pack_into("<3f2i", head, 76, 0.0, 23.0, 11.5, 1, 16)
    (tmp_path / "a.mrc").write_bytes(bytes(head) + b"\0" * 16 + data.tobytes())
    path = f"file://{tmp_path}/a.mrc"
    x = maps.read_headers(spark, path).first()
    assert (x["nx"], x["ny"], x["nz"], x["apix"], x["high"], x["is_volume"]) == (4, 3, 2, 1.5, 23.0, True)
    got = {s["section"]: s["values"] for s in maps.read_sections(spark, path).collect()}
    assert got == {k: data[k].ravel().tolist() for k in range(2)}
    assert [r["rlnImageName"] for r in exports.read_tables(spark, [path]).orderBy("rid").collect()] == [f"00000{k}@{tmp_path}/a.mrc" for k in (1, 2)]
    movie = "FoilHole_1464933_Data_427288_427290_20250502_213110"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / f"{movie}.xml").write_text('<MicroscopeImage xmlns="http://s"><microscopeData><optics><BeamShift xmlns:a="http://a"><a:_x>-0.25</a:_x><a:_y>0.5</a:_y></BeamShift></optics></microscopeData></MicroscopeImage>')
    shifts = maps.read_beam_shifts(spark, f"file://{tmp_path}/x/*.xml")
    mics = spark.createDataFrame([(f"/p/123456789012345678901_{movie}_fractions.mrc",), ("/p/other.mrc",)], "m string")
    got = {r["m"]: (r["beam_shift_x"], r["beam_shift_y"]) for r in maps.with_beam_shift(mics, shifts, "m").collect()}
    assert got == {f"/p/123456789012345678901_{movie}_fractions.mrc": (-0.25, 0.5), "/p/other.mrc": (None, None)}


def test_beam_shift_clusters(spark):
    r = random.Random(7)
    rows = [(k, i * 10.0 + r.gauss(0, 0.2), j * 10.0 + r.gauss(0, 0.2)) for k, (i, j) in enumerate([(i, j) for i in range(2) for j in range(2)] * 8)] + [(99, None, 1.0)]
    out = grouping.shift_clusters(spark.createDataFrame(rows, "rid long, x double, y double"), "x", "y", "g", clusters=range(2, 7)).collect()
    groups = collections.defaultdict(set)
    for x in out:
        if x["x"] is not None:
            groups[x["g"]].add((round(x["x"] / 10), round(x["y"] / 10)))
    assert sorted(groups) == [1, 2, 3, 4] and all(len(v) == 1 for v in groups.values())
    assert [x["g"] for x in out if x["x"] is None] == [None]


def test_paths_times_and_options(spark, tmp_path):
    (tmp_path / "a.mrcs").write_text("x")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/*").select("path", "modificationTime")
    df = spark.createDataFrame([(1, "000001@old/a.mrc"), (2, "000002@old/b.mrc")], "rid long, p string")
    got = {x["rid"]: x["p"] for x in paths.resolved(df, "p", files, [str(tmp_path)], required=False).collect()}
    assert got == {1: f"000001@{tmp_path}/a.mrcs", 2: "000002@old/b.mrc"}
    with pytest.raises(Exception, match="no file for"):
        paths.resolved(df, "p", files, [str(tmp_path)]).collect()
    known = spark.createDataFrame([(1, f"{tmp_path}/a.mrcs"), (2, "gone.mrcs")], "rid long, p string")
    assert {x["rid"]: x["pCreateTime"] is not None for x in columns.with_created_time(known, files, "p").collect()} == {1: True, 2: False}
    moved = paths.converted(known, "p", "relative", str(tmp_path.parent), str(tmp_path), files)
    assert {x["rid"]: x["p"] for x in moved.collect()} == {1: f"{tmp_path.name}/a.mrcs", 2: "gone.mrcs"}
    with pytest.raises(ValueError):
        options.run_options(df, [("nothing", "")])
    with pytest.raises(ValueError):
        options.option("select")(None)


def test_fourier_kernels_are_numpy_s(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(6, 8, 8))
    df = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(x)] + [(90, None), (91, [1.0])], "k long, v array<double>")
    back = lambda d: {q["k"]: q["v"] for q in d.collect()}
    crop = back(images.fourier_cropped(df, "k", "v", (8, 8), (4, 4)))
    assert crop[90] is None and crop[91] is None and all(abs(np.mean(crop[k]) - x[k].mean()) < 1e-9 for k in range(6))
    grown = back(images.fourier_cropped(df, "k", "v", (8, 8), (16, 16)))
    assert all(abs(np.mean(grown[k]) - x[k].mean()) < 1e-9 and len(grown[k]) == 256 for k in range(6))
    moved = back(images.shifted(df, "k", "v", (8, 8), (2, 3)))
    assert all(np.allclose(np.reshape(moved[k], (8, 8)), np.roll(x[k], (2, 3), (0, 1))) for k in range(6))
    power = back(images.structural_factors(df, "k", "v", (8, 8)))
    assert all(abs(sum(power[k]) - (np.abs(np.fft.fft2(x[k])) ** 2).sum()) < 1e-6 for k in range(6))
    flat = back(images.pass_filtered(df, "k", "v", (8, 8), 1.0, high_pass=1e-9))
    assert all(np.allclose(flat[k], 0, atol=1e-9) for k in range(6)) and np.allclose(back(images.pass_filtered(df, "k", "v", (8, 8), 1.0))[0], x[0].ravel())
    half = back(images.pass_filtered(df, "k", "v", (8, 8), 1.0, low_pass=4.0))
    assert abs(abs(np.fft.fft2(np.reshape(half[1], (8, 8)))[0, 2]) / abs(np.fft.fft2(x[1])[0, 2]) - 0.5) < 1e-9
    fallen = back(images.tapered(df, "k", "v", (8, 8), (0.5, 0.0), 0.25))
    assert np.allclose(np.reshape(fallen[2], (8, 8)), x[2] * np.array([0, 0, 1, 1, 1, 1, 1, 0])[:, None])
    mixed = back(images.phases_randomised(df, "k", "v", (8, 8), 1.0, 4.0))
    assert np.allclose(np.abs(np.fft.fft2(np.reshape(mixed[3], (8, 8)))), np.abs(np.fft.fft2(x[3]))) and np.allclose(np.fft.fft2(np.reshape(mixed[3], (8, 8)))[1, 1], np.fft.fft2(x[3])[1, 1]) and not np.allclose(mixed[3], x[3].ravel())
    both = spark.createDataFrame([(k, v.ravel().tolist(), np.roll(v, (1, -2), (0, 1)).ravel().tolist()) for k, v in enumerate(x)], "k long, a array<double>, b array<double>")
    assert {(q["dy"], q["dx"]) for q in images.best_shift(both, "k", "a", "b", (8, 8)).collect()} == {(-1, 2)}
