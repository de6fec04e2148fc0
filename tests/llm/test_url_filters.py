from datetime import date

import pytest
from pyspark.sql import functions as F

from wardlake.llm import url_filters


def day(n):
    return date(2024, 1, n)


ENTRIES = [
    ("block", "domain", "bad.com", "add", day(5)),
    ("block", "domain", "bad.com", "add", day(7)),
    ("block", "domain", "bad.com", "remove", day(10)),
    ("block", "domain", "bad.com", "add", day(20)),
    ("block2", "host", "a.good.org", "remove", day(2)),
    ("block2", "host", "a.good.org", "add", day(2)),
    ("block3", "prefix", "site.net/x/y", "add", day(1)),
    ("allow", "host", "ok.bad.com", "add", day(6)),
    ("block", None, "bad.com", "add", day(1)),
    ("block", "host", "odd.com", "drop", day(1)),
]


def test_intervals(spark):
    got = url_filters.validity_intervals(spark.createDataFrame(ENTRIES, "list string, kind string, value string, action string, day date"))
    found = {(r["list"], r.value, r["from"], r["to"]) for r in got.collect()}
    assert found == {
        ("block", "bad.com", day(5), day(10)),
        ("block", "bad.com", day(20), None),
        ("block2", "a.good.org", day(2), None),
        ("block3", "site.net/x/y", day(1), None),
        ("allow", "ok.bad.com", day(6), None),
    }


@pytest.mark.parametrize(
    "url, fetched, active, blocked",
    [
        ("http://bad.com/", day(4), [], False),
        ("http://bad.com/", day(5), ["block"], True),
        ("https://user@deep.sub.BAD.com:8080/p?q#f", day(9), ["block"], True),
        ("http://bad.com/", day(10), [], False),
        ("http://bad.com./", day(25), ["block"], True),
        ("http://notbad.com/", day(25), [], False),
        ("http://ok.bad.com/", day(7), ["allow", "block"], False),
        ("http://a.good.org", day(2), ["block2"], True),
        ("http://b.a.good.org", day(2), [], False),
        ("http://site.net/x//y/z?u", day(3), ["block3"], True),
        ("http://site.net/x/yy", day(3), [], False),
        ("", day(7), [], False),
        (None, day(7), [], False),
        ("no url", day(7), [], False),
        ("http://bad.com/", None, [], False),
        ("http://site.net/x/y/" + "a/" * 300, day(3), ["block3"], True),
    ],
)
def test_captures(spark, url, fetched, active, blocked):
    entries = spark.createDataFrame(ENTRIES, "list string, kind string, value string, action string, day date")
    captures = spark.createDataFrame([(1, url, fetched, "h", 2)] * 2, "id int, url string, day date, host string, row int")
    got = url_filters.judge(captures, entries).collect()
    assert [(r.id, r.host, r.row, r.active, r.blocked) for r in got] == [(1, "h", 2, active, blocked)] * 2
    assert "_host" in got[0].asDict()


def test_empty_tables(spark):
    schema = "list string, kind string, value string, action string, day date"
    none = spark.createDataFrame([], schema)
    captures = spark.createDataFrame([("http://bad.com", day(5))], "url string, day date")
    assert url_filters.judge(captures, none).filter("blocked").count() == 0
    assert url_filters.judge(captures.filter(F.lit(False)), spark.createDataFrame(ENTRIES, schema)).count() == 0
