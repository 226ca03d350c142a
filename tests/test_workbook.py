"""Tables written together: names, versions and what is read back."""

import datetime as dt

import pytest

from tallyfold.sources import workbook

LONG = "A table with a rather long name, number "


def test_names():
    names = workbook.sheet_names([LONG + "one", LONG + "two", (LONG + "THREE").upper(), "a/b:c", "a*b?c", "", "'x'", "[x]"])
    assert names[0] == LONG[:31] and names[1] == LONG[:29] + "~2" and names[2] == LONG.upper()[:29] + "~3"
    assert names[3:] == ["a_b_c", "a_b_c~2", "_", "x", "_x_"]
    assert len({n.lower() for n in names}) == len(names) and max(map(len, names)) <= 31
    assert len(set(workbook.sheet_names(["x" * 40] * 120))) == 120


@pytest.mark.parametrize("kind", workbook.FORMATS)
def test_round_trip(spark, tmp_path, kind):
    day = dt.date(2020, 2, 29)
    rows = [(day, "a", 1.5), (None, "", None), (day, None, -0.1), (day, 'quo"te, comma\nline', 1e300)]
    one = spark.createDataFrame(rows, "d date, s string, x double")
    two = spark.createDataFrame([(1, "ä"), (2, "\\N x")], "k long, s string")
    nothing = spark.createDataFrame([], "k long, s string")
    folder = str(tmp_path / "book")
    version = workbook.save({LONG + "one": one, LONG + "two": two, "none/at all": nothing}, folder, spark, kind)
    listed = {r["name"]: (r["rows"], r["version"]) for r in workbook.manifest(spark, folder).collect()}
    assert listed == {LONG + "one": (4, version), LONG + "two": (2, version), "none/at all": (0, version)}
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, workbook.load(spark, folder, LONG + "one").collect()), key=key) == sorted(rows, key=key)
    assert sorted(map(tuple, workbook.load(spark, folder, LONG + "two").collect())) == [(1, "ä"), (2, "\\N x")]
    assert workbook.load(spark, folder, "none/at all").schema == nothing.schema


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "set")
    with pytest.raises(LookupError):
        workbook.load(spark, folder, "t")
    first = workbook.save({"t": spark.range(3)}, folder, spark, "parquet", dt.datetime(2024, 1, 1))
    second = workbook.save({"t": spark.range(5)}, folder, spark, "parquet", dt.datetime(2024, 1, 2))
    # one that broke off before its manifest
    spark.range(9).write.parquet(f"{folder}/99990101T000000000000-x/t-t")
    assert workbook.load(spark, folder, "t").count() == 5 and workbook.load(spark, folder, "t", first).count() == 3
    assert first < second
    for name, version in (("u", None), ("t", "none")):
        with pytest.raises(LookupError):
            workbook.load(spark, folder, name, version)
    with pytest.raises(ValueError):
        workbook.save({}, folder, spark, "xls")
