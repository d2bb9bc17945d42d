from datetime import datetime, timezone

import pytest

from leafmill.operators.timestamps import normalised, readings

SCHEMA = "rec string, value string, source string, home_zone string, date_order string"


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    "value, zone, order, want",
    [
        ("D:20240304050607Z", "UTC", "dmy", us(2024, 3, 4, 5, 6, 7)),
        ("D:20210815032348+01'00'", "UTC", "dmy", us(2021, 8, 15, 2, 23, 48)),
        ("D:20230504", "Europe/Paris", "dmy", us(2023, 5, 3, 22)),
        ("03/09/2015 2:07 AM", "America/New_York", "mdy", us(2015, 3, 9, 6, 7)),
        ("03/08/2015 12:07 AM", "UTC", "dmy", us(2015, 8, 3, 0, 7)),
        ("Tue, 21 Feb 2023 09:21:12 +0100", "UTC", "dmy", us(2023, 2, 21, 8, 21, 12)),
        ("20 Dec 2024 23:36:50 CET", "Europe/Paris", "dmy", us(2024, 12, 20, 22, 36, 50)),
        ("2021-08-19 16:55:58 CST", "Asia/Shanghai", "dmy", us(2021, 8, 19, 8, 55, 58)),
        ("2021-08-19 16:55:58 CST", "America/Chicago", "mdy", us(2021, 8, 19, 22, 55, 58)),
        ("2018-03-31 13:22:05 GMT+4", "UTC", "dmy", us(2018, 3, 31, 9, 22, 5)),
        ("1601190893", "UTC", "dmy", 1601190893000000),
        ("1586760548788", "UTC", "dmy", 1586760548788000),
        ("2018-10-27T09:10:26.173475525Z", "UTC", "dmy", us(2018, 10, 27, 9, 10, 26) + 173475),
        (" 2022-06-22T00:23:34+02:00 ", "UTC", "dmy", us(2022, 6, 21, 22, 23, 34)),
        ("20240711T040213+02", "UTC", "dmy", us(2024, 7, 11, 2, 2, 13)),
        ("2019-05-21 03:51:48 Europe/Madrid", "UTC", "dmy", us(2019, 5, 21, 1, 51, 48)),
    ],
)
def test_notations(value, zone, order, want):
    found = readings(value, zone)
    assert {u for k, u, s in found if s == "instant" and (k not in ("dmy", "mdy") or k == order)} == {want}


@pytest.mark.parametrize("value", [None, "", "yesterday", "D:", "2021-02-30 10:00:00", "31.06.2020 08:00", "0000-00-00 00:00:00", "D:20231345101500", "13/13/2020 10:00", "2020-01-01 25:00", "x" * 100_000])
def test_unusable(value):
    assert not [x for x in readings(value, "Europe/Paris")]


def test_clock_changes():
    assert readings("2022-03-27 01:30:00", "Europe/London")[0][2] == "skipped"
    assert readings("2022-10-30 01:30:00", "Europe/London")[0][2] == "repeated"
    assert readings("2022-10-30 01:30:00 BST", "Europe/London")[0] == ("ymd", us(2022, 10, 30, 0, 30), "instant")


def test_mixture_decides_the_order_of_a_source_without_one(spark):
    rows = [(str(i), f"{13 + i % 15}/0{1 + i % 9}/2020 10:00", "a", "UTC", None) for i in range(40)] + [("x", "02/03/2020 10:00", "a", "UTC", None)]
    rows += [("y", "02/03/2020 10:00", "b", "UTC", None), ("z", "04/04/2020 10:00", "b", "UTC", None)]
    found = {r.rec: r for r in normalised(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["x"].kind == "dmy" and found["x"].utc_us == us(2020, 3, 2, 10)
    assert found["y"].time_status == "ambiguous" and found["y"].utc_us is None
    assert found["z"].time_status == "instant" and found["z"].utc_us == us(2020, 4, 4, 10)


def test_known_order_is_a_prior(spark):
    """It decides alone, it makes a date of the other order no date where those are rare, and very many values can turn it."""
    rows = [("known", "02/03/2020 10:00", "a", "UTC", "mdy"), ("never", "31/12/2020 10:00", "a", "UTC", "mdy"), ("none", "31/06/2020 10:00", "a", "UTC", "mdy"), ("empty", "n/a", "a", "UTC", "mdy")]
    rows += [(f"b{i}", f"{13 + i % 15}/0{1 + i % 9}/2020 10:{i % 60:02}", "b", "UTC", "mdy") for i in range(30_000)] + [("turned", "02/03/2020 10:00", "b", "UTC", "mdy")]
    found = {r.rec: r for r in normalised(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["known"].utc_us == us(2020, 2, 3, 10) and found["known"].posterior > 0.95
    assert [found[x].time_status for x in ("none", "empty")] == ["unusable"] * 2 and found["never"].utc_us is None and found["never"].time_status != "instant"
    assert found["turned"].utc_us == us(2020, 3, 2, 10) and found["b5"].kind == "dmy"


def test_edges(spark):
    rows = [("1", None, None, None, None), ("2", "2020-01-01", None, None, None), ("3", "2020-01-01T00:00Z", None, None, None), ("3", "2020-01-01T00:00Z", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as kind", "2 as sig", "3 as read", "4 as posterior")
    found = normalised(df)
    got = sorted((r.rec, r.time_status, r.utc_us) for r in found.collect())
    assert got == [("1", "unusable", None), ("2", "unusable", None), ("3", "instant", us(2020, 1, 1)), ("3", "instant", us(2020, 1, 1))]
    assert found.columns.count("kind") == 1 and {"sig", "read"} <= set(found.columns)
    assert normalised(df.limit(0)).count() == 0


def test_query(spark):
    from leafmill.queries import queries

    rows = queries()["p3_found"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({(r.unit, r.rec_id, r.field) for r in rows}) > 150
