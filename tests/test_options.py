"""Chains of options over rows, optics and other tables, and the small operators that they use."""

import pytest
from pyspark.sql import functions as F

from filamenta.operators import columns as C
from filamenta.operators import grouping as G
from filamenta.operators import selection as S
from filamenta.plans.options import OPTIONS, PAIRED, Tables, run_options, run_with_optics


def _rows(spark):
    return spark.createDataFrame([(k, k % 2, "ab"[k % 3 == 0], f"{10 - k:06d}@s{k % 2}.mrcs", float(k), 10.0 * k, 0.0, k % 2 + 1) for k in range(8)], "rid long, mic long, tube string, image string, track double, psi double, score double, rlnOpticsGroup int")


def _optics(spark):
    return spark.createDataFrame([(1, "one", 300.0, 1.5), (2, "two", 300.0, 1.5), (3, "three", 200.0, 1.5)], "rlnOpticsGroup int, rlnOpticsGroupName string, rlnVoltage double, rlnImagePixelSize double")


def test_values_go_to_the_optics_table_where_it_has_the_column(spark):
    t = run_with_optics(Tables(_rows(spark), _optics(spark)), [("setParm", "rlnVoltage 120.5"), ("setParm", "score 4.5"), ("apix", "3"), ("usedOptics", "")])
    assert {(r["rlnOpticsGroup"], r["rlnVoltage"], r["rlnImagePixelSize"]) for r in t.optics.collect()} == {(1, 120.5, 3.0), (2, 120.5, 3.0)}
    assert "rlnVoltage" not in t.rows.columns and {r["score"] for r in t.rows.collect()} == {4.5}
    alone = run_with_optics(Tables(_rows(spark)), [("setParm", "rlnVoltage 120.5"), ("apix", "3")])
    assert {r["rlnVoltage"] for r in alone.rows.collect()} == {120.5} and alone.optics is None


def test_optics_follow_the_micrographs_and_dissolve_into_rows(spark):
    t = run_with_optics(Tables(_rows(spark).withColumn("image", F.element_at(F.split("image", "@"), -1)), _optics(spark)), [("assignOpticGroupPerMicrograph", ""), ("dissolveOptics", "")])
    assert t.optics is None and {(r["mic"], r["rlnOpticsGroup"], r["rlnVoltage"]) for r in t.rows.collect()} == {(0, 1, 300.0), (1, 2, 300.0)}
    one = run_with_optics(Tables(_rows(spark), _optics(spark)), [("resetOpticGroup", "")])
    assert one.optics.count() == 1 and {r["rlnOpticsGroup"] for r in one.rows.collect()} == {1}


def test_a_group_without_optics_is_an_error(spark):
    with pytest.raises(Exception, match="no optics group 2"):
        G.dissolve_optics(_rows(spark), _optics(spark).where("rlnOpticsGroup <> 2"), "rlnOpticsGroup").collect()
    none = _rows(spark).withColumn("rlnOpticsGroup", F.lit(None).cast("int"))
    assert {r["rlnVoltage"] for r in G.dissolve_optics(none, _optics(spark), "rlnOpticsGroup").collect()} == {None}


def test_other_tables_by_name(spark):
    rows = _rows(spark)
    others = {"some": Tables(rows.where("rid < 3").withColumn("score", F.lit(9.0)))}
    chain = lambda *c: run_with_optics(Tables(rows, others=others), list(c)).rows
    assert {r["rid"] for r in chain(("selectFile", "some")).collect()} == {0, 1, 2}
    assert {r["rid"] for r in chain(("excludeFile", "some")).collect()} == {3, 4, 5, 6, 7}
    assert {r["rid"]: r["score"] for r in chain(("selectFile", "some"), ("copyParm", "some score")).collect()} == {0: 9.0, 1: 9.0, 2: 9.0}
    assert chain(("selectFile", "some"), ("recoverFullFilaments", "some 0")).count() == 3
    for bad in (("selectFile", "nothing"), ("noSuchOption", ""), ("resetOpticGroup", "x y z")):
        with pytest.raises((ValueError, TypeError)):
            chain(bad)
    with pytest.raises(ValueError, match="optics"):
        chain(("assignOpticGroupByTime", "5"))


@pytest.mark.parametrize("name, argument, n", [("last", "3", 3), ("psiPrior180", "", 16), ("splitByMicrograph", "", 8), ("splitNumSets", "2", 8), ("extractHelices", "1", 2), ("assignExposureGroupPerMicrograph", "", 8), ("resetExposureGroups", "", 8), ("setBeamTiltClass", "", 8), ("estimateHelicalTubeLength", "", 8), ("replaceImageName", "x.mrcs", 8), ("path", "absolute /data", 8)])
def test_options_on_rows(spark, name, argument, n):
    assert run_options(_rows(spark), [(name, argument)]).count() == n


def test_no_option_is_lost():
    assert len({*OPTIONS, *PAIRED}) >= 55


def test_images_sort_by_file_then_number(spark):
    got = [r["rid"] for r in run_options(_rows(spark), [("sortby", "image")]).collect()]
    assert got == [6, 4, 2, 0, 7, 5, 3, 1]
    assert [r["rid"] for r in run_options(_rows(spark), [("rsortby", "image")]).collect()] == got[::-1]
    with pytest.raises(ValueError, match="no column nothing"):
        run_options(_rows(spark), [("sortby", "nothing")])


def test_names_of_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, a2 int, ab int")
    assert C.free_name(df, "a") == "a3" and C.free_name(df, "b") == "b"
    assert C.names_with(df, "a") == ["a", "a2", "ab"] and C.first_name(df, ["x", "ab", "a"]) == "ab" and C.first_name(df, ["x"]) is None


def test_opposites_and_storage_of_nothing(spark):
    none = _rows(spark).where("false")
    assert S.with_opposite(none, "psi", "mic").count() == 0
    heads = spark.createDataFrame([("s0.mrcs", 4, 5)], "file string, nx int, ny int")
    assert tuple(C.storage(none, heads, "image").first()) == (0, 0, 0)
    assert tuple(C.storage(_rows(spark), heads, "image").first()) == (8, 2, 4 * 80)
