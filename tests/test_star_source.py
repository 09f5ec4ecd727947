"""STAR files by ranges of bytes, and single files that many tasks write."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filamenta.sources import exports, maps, star_source, streams
from filamenta.sources.star import loops, read_star, read_star_tables, write_star_file

HEAD = "# version 30001\n\ndata_optics\n\nloop_\n_rlnOpticsGroup #1\n_rlnVoltage #2\n1 300.0\n2 200.0\n\n\ndata_particles\n\nloop_ \n_rlnImageName #1\n_rlnClassNumber #2\n_rlnAnglePsi #3\n_rlnNote #4\n"


def written(tmp_path, rows, tail=""):
    notes = ["plain", "'two words'", '"a # b"', "ünï"]
    body = "".join(f"{k + 1:06d}@s_{k % 7}.mrcs\t{k % 5}\t{k / 8}\t{notes[k % 4]}\n" + ("\n# remark\n" if k % 11 == 0 else "") for k in range(rows))
    path = tmp_path / f"t{rows}.star"
    path.write_text(HEAD + body + tail)
    return path


@pytest.mark.parametrize("split", [7, 97, 1000, star_source.SPLIT])
def test_ranges_of_any_size_read_the_same_rows(spark, tmp_path, split):
    path = written(tmp_path, 150, "\ndata_movies_later\n\nloop_\n_rlnX\n1\n2\n")
    want = [(k, f"{k + 1:06d}@s_{k % 7}.mrcs", k % 5, k / 8, ["plain", "two words", "a # b", "ünï"][k % 4]) for k in range(150)]
    df = read_star(spark, f"file://{path}", split=split)
    assert df.columns == ["rid", "rlnImageName", "rlnClassNumber", "rlnAnglePsi", "rlnNote"]
    assert sorted(tuple(r) for r in df.collect()) == want
    assert [tuple(r)[1:] for r in sorted(read_star(spark, str(path), "optics", split).collect())] == [(1, 300.0), (2, 200.0)]
    assert read_star(spark, str(path), "movies_later", split).count() == 2
    assert star_source.star_frame(spark, str(path), split=split).rdd.getNumPartitions() >= min(3, 8000 // split)


def test_the_format_is_registered_with_columns_and_filters(spark, tmp_path):
    path = written(tmp_path, 1000)
    spark.dataSource.register(star_source.StarSource)
    spark.conf.set(star_source.PUSHDOWN, "true")
    df = spark.read.format("star").option("split", 2000).option("columns", "rlnAnglePsi,rlnNote").load(str(path))
    assert df.columns == ["file", "part", "row", "rlnAnglePsi", "rlnNote"] and df.where("rlnNote = 'plain'").count() == 250
    typed = spark.read.format("star").option("split", 2000).schema("rlnClassNumber long, rlnAnglePsi double").load(str(path))
    assert typed.where("rlnClassNumber in (1, 3) and rlnAnglePsi >= 100.5").count() == sum(k % 5 in (1, 3) and k / 8 >= 100.5 for k in range(1000))
    reader = star_source.StarReader(typed.schema, {"path": str(path)}, {})
    f = star_source.ds.GreaterThan(("rlnAnglePsi",), 120.0)
    assert list(reader.pushFilters([f])) == [f] and reader.filters == [f]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == sum(k / 8 > 120 for k in range(1000))  # the source itself leaves rows out
    many = spark.read.format("star").load(f"{tmp_path}/*.star")
    assert many.count() == 1000
    with pytest.raises(Exception, match="no block nothing"):
        spark.read.format("star").option("block", "nothing").load(str(path)).count()


def test_a_source_table_comes_back(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "value")
    rows = sorted(tuple(r) for r in events.collect())
    path = tmp_path / "e.star"
    path.write_text("data_particles\nloop_\n_id\n_kind\n_value\n" + "".join(f"{a} {b} {c!r}\n" for a, b, c in rows))
    df = read_star(spark, str(path), split=4096)
    assert [(int(r["id"]), r["kind"], r["value"]) for r in df.orderBy("rid").collect()] == rows
    assert df.agg(F.max("rid")).first()[0] == len(rows) - 1 and df.select("rid").distinct().count() == len(rows)


def test_odd_files(spark, tmp_path):
    def of(text, **k):
        (tmp_path / "o.star").write_text(text)
        return [tuple(r) for r in read_star(spark, str(tmp_path / "o.star"), **k).orderBy("rid").collect()]

    assert of("data_particles\nloop_\n_a\n_b\n1 2\n3\n5 6") == [(0, 1.0, 2.0), (2, 5.0, 6.0)]  # a row with a missing value goes
    assert of("data_x\n\nloop_\n_a\n") == []
    assert of("data_\r\nloop_\r\n_a #1\r\n1\r\n2\r\n", split=3) == [(0, 1.0), (1, 2.0)]
    assert of("data_images\nloop_\n_rlnClassNumber\nx\n2.0\n") == [(1, 2)]
    rows, optics = read_star_tables(spark, str(written(tmp_path, 3)))
    assert rows.count() == 3 and optics.count() == 2
    assert [b for b, _, _ in loops((tmp_path / "t3.star").read_text())] == ["optics", "particles"]


def test_one_star_file_from_many_tasks(spark, tmp_path):
    rows = [(k, f"{k:06d}@a.mrcs", k / 3, "two words" if k % 2 else None, k if k % 5 else None) for k in range(500, 0, -1)]
    df = spark.createDataFrame(rows, "rid long, rlnImageName string, rlnAnglePsi double, rlnNote string, rlnClassNumber long")
    optics = spark.createDataFrame([(2, "b"), (1, "a")], "rlnOpticsGroup long, rlnOpticsGroupName string")
    path = tmp_path / "one.star"
    write_star_file(df, str(path), optics)
    found = {b: (c, r) for b, c, r in loops(path.read_text())}
    assert found["optics"][1] == [["1", "a"], ["2", "b"]]
    assert found["particles"][1] == [[f"{k:06d}@a.mrcs", repr(round(k / 3, 6)), "two words" if k % 2 else "None", str(k) if k % 5 else "nan"] for k in range(1, 501)]
    write_star_file(df.where("rid < 3"), str(path))  # replaces it
    assert len(next(loops(path.read_text()))[2]) == 2 and [p.name for p in tmp_path.iterdir()] == ["one.star"]


def test_a_retried_task_leaves_nothing(spark, tmp_path):
    from pyspark.errors import PySparkException

    def once(partition, attempt):
        if partition == 1 and attempt == 0:
            raise OSError("lost")

    def encode(batch):
        return "".join(f"{v}\n" for v in batch.column("id").to_pylist()).encode()

    frame = spark.range(1000).withColumnRenamed("id", "id").repartition(4)
    path = tmp_path / "r.txt"
    try:
        n = streams.write_stream(frame, str(path), encode, lambda n: f"{n}\n".encode(), ["id"], once)
    except PySparkException:  # a local session doesn't retry: then there is no file at all
        assert list(tmp_path.iterdir()) == []
        n = streams.write_stream(frame, str(path), encode, lambda n: f"{n}\n".encode(), ["id"])
    assert n == 1000 and path.read_text() == "1000\n" + "".join(f"{k}\n" for k in range(1000)) and [p.name for p in tmp_path.iterdir()] == ["r.txt"]


def test_one_export_from_many_tasks(spark, tmp_path):
    rows = [(k, None if k % 3 == 0 else f"p{k}", None if k % 4 == 0 else k / 2, [1.0, None] if k % 2 else None, k % 2 == 0) for k in range(200, 0, -1)]
    df = spark.createDataFrame(rows, "uid long, `blob/path` string, `ctf/df` double, `alignments/shift` array<double>, keep boolean")
    path = tmp_path / "one.cs"
    exports.write_export(df, str(path), one_file=True, order=["uid"])
    table = np.load(path)
    assert table["uid"].tolist() == list(range(1, 201)) and table["blob/path"].tolist() == [b"" if k % 3 == 0 else f"p{k}".encode() for k in range(1, 201)]
    assert [v != v for v in table["ctf/df"]] == [k % 4 == 0 for k in range(1, 201)] and table["alignments/shift"].shape == (200, 2) and table["keep"].dtype == bool
    exports.write_export(df, str(tmp_path / "many"))
    assert sum(len(np.load(p)) for p in (tmp_path / "many").glob("*.cs")) == 200
    with pytest.raises(ValueError, match="uid"):
        exports.write_export(spark.createDataFrame([(None,)], "uid long"), str(tmp_path / "x.cs"), one_file=True)
    exports.write_table(df.withColumn("rid", -F.col("uid")), str(tmp_path / "t.cs"))
    assert np.load(tmp_path / "t.cs")["uid"].tolist() == list(range(200, 0, -1))


def test_a_map_from_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    cube = rng.standard_normal((5, 4, 3)).astype(np.float32)
    voxels = [(z, y, x, float(cube[z, y, x])) for z in range(5) for y in range(4) for x in range(3) if (z, y, x) != (2, 1, 0)] + [(2, 1, 0, None)]
    path = tmp_path / "m.mrc"
    maps.write_map(spark.createDataFrame(voxels, "z int, y int, x int, value double"), str(path), 1.5)
    cube[2, 1, 0] = 0
    assert (np.frombuffer(path.read_bytes()[1024:], "<f4").reshape(5, 4, 3) == cube).all()
    head = maps.read_headers(spark, f"file://{path}").first()
    assert (head["nx"], head["ny"], head["nz"], head["mode"], head["is_volume"]) == (3, 4, 5, 2, True) and abs(head["apix"] - 1.5) < 1e-6 and abs(head["mean"] - cube.mean()) < 1e-6
    sections = {r["section"]: r["values"] for r in maps.read_sections(spark, f"file://{path}").collect()}
    assert np.allclose(sections[3], cube[3].ravel())


def test_optics_of_several_files_are_united(spark, tmp_path):
    head = "data_optics\nloop_\n_rlnOpticsGroup\n_rlnVoltage\n{}\n\ndata_particles\nloop_\n_rlnImageName\n_rlnOpticsGroup\n{}\n"
    (tmp_path / "a.star").write_text(head.format("1 300\n2 200", "1@a 1\n2@a 2"))
    (tmp_path / "b.star").write_text(head.format("1 100", "1@b 1"))
    spark.createDataFrame([("3@c",)], "rlnImageName string").write.parquet(f"file://{tmp_path}/c.parquet")
    rows, optics = exports.read_tables_with_optics(spark, [f"{tmp_path}/a.star", f"{tmp_path}/b.star", f"file://{tmp_path}/c.parquet"])
    assert {(r["rlnImageName"], r["rlnOpticsGroup"]) for r in rows.collect()} == {("1@a", 1), ("2@a", 2), ("1@b", 3), ("3@c", None)}
    assert {(r["rlnOpticsGroup"], r["rlnVoltage"]) for r in optics.collect()} == {(1, 300.0), (2, 200.0), (3, 100.0)}
    assert exports.read_tables_with_optics(spark, [f"file://{tmp_path}/c.parquet"])[1] is None
