"""Job histories: notes, forks, rings and missing jobs."""

from filamenta.operators import jobs


def test_notes_are_read_from_the_last_line(spark):
    note = 'relion_a --i Extract/job001/particles.star --o x\n\nrelion_b --i "Select/job002/particles.star" --coord_list AutoPick/job003/a.star --j 4\n'
    df = spark.createDataFrame([("Class2D/job009", note), ("Import/job000", "nothing"), ("X/job1", "run --reextract_data_star R/job5/p.star")], "job string, note string")
    got = {r["job"]: tuple(r)[1:] for r in jobs.input_edges(df).collect()}
    assert got == {"Class2D/job009": ("Select/job002/particles.star", "AutoPick/job003/a.star", None), "Import/job000": (None, None, None), "X/job1": (None, None, "R/job5/p.star")}


def test_histories(spark):
    rows = [
        ("c3", "c2", None, None), ("c2", "Extract/2", None, None), ("Extract/2", "s", None, "r"), ("r", "Extract/1", None, None), ("Extract/1", "m", "AutoPick/1", None), ("m", None, None, None),
        ("ring1", "ring2", None, None), ("ring2", "ring1", None, None), ("to ring", "ring1", None, None), ("open", "not described", None, None), ("alone", None, None, None), *[(f"d{k}", f"d{k + 1}", None, None) for k in range(50)], ("d50", "Polish/9", None, None),
    ]
    df = spark.createDataFrame(rows, "job string, input string, coordinates string, reextract string")
    starts = spark.createDataFrame([(j,) for j in ["c3", "ring1", "to ring", "open", "alone", "d0", "nobody", "r", "Extract/1"]], "job string")
    got = {r["job"]: tuple(r)[1:] for r in jobs.traced(df, starts).collect()}
    assert got == {"c3": ("Extract/2", True, 2), "ring1": (None, False, 0), "to ring": (None, False, 0), "open": ("not described", False, 1), "alone": (None, False, 0), "d0": ("Polish/9", True, 51), "nobody": (None, False, 0), "r": ("Extract/1", True, 1), "Extract/1": ("m", False, 1)}
    picks = {r["job"]: tuple(r)[1:] for r in jobs.traced(df, starts, True).collect()}
    assert picks["c3"] == ("Extract/1", True, 4) and picks["d0"][1] is False
    assert jobs.traced(df.limit(0), starts).where("source is not null").count() == 0
