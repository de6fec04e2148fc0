import random
from datetime import datetime, timedelta

import pytest

from wardlake.operators import codes
from wardlake.operators.comorbidity_groups import (
    CCI_FLAGS, ECI_FLAGS, custom_dimension, prefix_dimension, prefix_rows,
)

T0 = datetime(2015, 1, 1)
day = lambda n: T0 + timedelta(days=n)


def test_prefix_rows():
    rows = prefix_rows()
    assert len(rows) == len(set(rows))
    assert {len(p) for _, _, _, p in rows} == {3, 4, 5}
    assert len(CCI_FLAGS) == 17 and len(ECI_FLAGS) == 31
    extra = set(prefix_rows(published=True)) - set(rows)
    assert ("charlson", 9, "hemiplegia or paraplegia", "3441") in extra


def test_groups_of_codes(spark):
    df = spark.createDataFrame(
        [("I42.6", 10), (" 250.40", 9), ("E1165", 10), ("I501", 9), ("XYZ", 10), (None, 10)], "icd_code string, icd_version int"
    )
    hits = {}
    for r in codes.match_prefixes(df, prefix_dimension(spark)).collect():
        hits.setdefault(r["icd_code"], set()).add((r["scheme"], r["group"]))
    assert hits["I42.6"] == {
        ("charlson", "congestive heart failure"), ("elixhauser", "congestive heart failure"), ("elixhauser", "alcohol abuse"),
    }
    assert hits[" 250.40"] == {
        ("charlson", "diabetes with chronic complication"), ("elixhauser", "diabetes, complicated"),
    }
    assert ("charlson", "diabetes without chronic complication") in hits["E1165"]
    assert set(hits) == {"I42.6", " 250.40", "E1165"}


def test_custom_groups_and_errors(spark):
    df = spark.createDataFrame([("33010", 9), ("34", 9)], "icd_code string, icd_version int")
    dim = custom_dimension(spark, {"stroke": ["33"], "any": ["3"]}, 9)
    rows = codes.code_groups(df, dim, "custom").orderBy("icd_code").collect()
    assert [r["custom_comorbidity"] for r in rows] == [["any", "stroke"], ["any"]]
    with pytest.raises(ValueError):
        codes.code_groups(df, dim, "other")
    with pytest.raises(ValueError):
        custom_dimension(spark, {}, 8)
    with pytest.raises(TypeError):
        custom_dimension(spark, {"a": "33"}, 9)
    known = spark.createDataFrame([("33010", 9)], "icd_code string, icd_version int")
    bad = spark.createDataFrame([("33010", 9), ("1", 9), ("33010", 7), (None, 9)], "icd_code string, icd_version int")
    assert sorted(r["reason"] for r in codes.rejected_codes(bad, known).collect()) == ["missing", "unknown", "version"]


def test_conversion(spark):
    pairs = spark.createDataFrame([("A1", "111"), ("A1", "222"), ("B1", "33344")], "source_code string, target_code string")
    unique = codes.unique_code_map(pairs)
    assert {tuple(r) for r in unique.collect()} == {("A1", "222"), ("B1", "33344")}
    df = spark.createDataFrame([("A1", 10), ("B1", 10), ("B1", 9), ("C99999", 10)], "icd_code string, icd_version int")
    full = [r["converted"] for r in codes.convert_codes(df, unique, 9).collect()]
    assert sorted(full) == sorted(["222", "33344", "B1", "C99999"])
    short = [r["converted"] for r in codes.convert_codes(df, unique, 9, digit3=True).collect()]
    assert sorted(short) == sorted(["222", "333", "B1", "C99"])
    free = codes.convert_codes(df, unique, 9, digit3=True, version=None)
    assert sorted(r["converted"] for r in free.collect()) == sorted(["222", "333", "333", "C99"])


def test_lookback_against_brute_force(spark):
    rng = random.Random(3)
    subjects = [1] * 40 + [rng.randint(2, 9) for _ in range(80)]
    stays = [(s, k, day(rng.randint(0, 400))) for k, s in enumerate(subjects)]
    seen = [(s, rng.choice("abcd"), day(rng.randint(0, 400)) if rng.random() > 0.1 else None) for s in subjects for _ in range(3)]
    visits = spark.createDataFrame(stays, "subject_id long, stay_id long, intime timestamp_ntz")
    events = spark.createDataFrame(seen, "subject_id long, flag string, t timestamp_ntz")
    for days in (1, 30, 365):
        expected = {
            (k, c) for s, k, t in stays for e, c, u in seen if e == s and u is not None and u < t <= u + timedelta(days=days)
        }
        got = codes.lookback_codes(visits, events, "flag", "t", days).collect()
        assert len(got) == len(expected) and {(r["stay_id"], r["flag"]) for r in got} == expected
        flags = codes.lookback_flags(visits, events, ["a", "b", "d"], "t", days).collect()
        assert len(flags) == len(stays)
        assert {(r["stay_id"], f) for r in flags for f in "abd" if r[f]} == {(k, c) for k, c in expected if c in "abd"}


def test_more_flags_than_one_mask_holds(spark):
    names = [f"f{i}" for i in range(130)]
    visits = spark.createDataFrame([(1, 1, day(10))], "subject_id long, stay_id long, intime timestamp_ntz")
    events = spark.createDataFrame([(1, n, day(9)) for n in ("f0", "f61", "f62", "f129")], "subject_id long, flag string, t timestamp_ntz")
    row = codes.lookback_flags(visits, events, names, "t", 5).first().asDict()
    assert {n for n in names if row[n]} == {"f0", "f61", "f62", "f129"}


def test_code_index_has_no_gaps(spark):
    names = ["I10", "I1", "042", "Z9", "E11", "E110", "A", "B2", *[f"common{i:04d}" for i in range(300)]]
    df = spark.createDataFrame([(n,) for n in [*names * 2, None]], "c string")
    got = {r["code"]: r["code_idx"] for r in codes.code_index(df, "c").collect()}
    assert got == {c: i for i, c in enumerate(sorted(names))}


def test_code_lists_of_a_stay_without_history(spark):
    visits = spark.createDataFrame([(1, 1, day(10)), (2, 2, day(10))], "subject_id long, stay_id long, intime timestamp_ntz")
    dated = spark.createDataFrame(
        [(1, "A1", 10, day(1)), (1, "zz", 9, day(2)), (1, "B", 9, day(11))],
        "subject_id long, icd_code string, icd_version int, dischtime timestamp_ntz",
    )
    pairs = spark.createDataFrame([("A1", "11122")], "source_code string, target_code string")
    rows, index = codes.code_lists(visits, dated, pairs, "v9_3digit")
    got = {r["stay_id"]: (r["icd_list"], r["icd_encoded_list"]) for r in rows.collect()}
    assert got == {1: (["111", "zz"], [0, 1]), 2: ([], [])}
    assert index.count() == 2
    with pytest.raises(ValueError):
        codes.code_lists(visits, dated, pairs, "v8")


def test_atc_levels(spark):
    atc = spark.createDataFrame(
        [(1, "C", "heart"), (2, "C07", "beta"), (5, "C07AB02", "metoprolol")], "level int, code string, description string"
    )
    df = spark.createDataFrame([("c07ab02",), ("C07",)], "atc_id string")
    rows = {(r["atc_id"], r["level"]): (r["code"], r["description"]) for r in codes.atc_classes(df, atc).collect()}
    assert rows[("c07ab02", 5)] == ("C07AB02", "metoprolol") and rows[("c07ab02", 3)] == ("C07A", None)
    assert rows[("C07", 5)] == (None, None) and rows[("C07", 2)] == ("C07", "beta")


def test_events_of_a_lookback_are_shuffled_once(spark):
    visits = spark.createDataFrame([(1, 1, day(10))], "subject_id long, stay_id long, intime timestamp_ntz")
    events = spark.createDataFrame([(1, "a", day(9))], "subject_id long, flag string, t timestamp_ntz")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = codes.recent_facts(visits, events, ["flag"], "t", 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One for the events and one for the visits.
    assert plan.count("Exchange hashpartitioning") == 2


def test_code_lists_are_looked_up_without_a_shuffle(spark, monkeypatch):
    rng = random.Random(5)
    stays = [(rng.randint(1, 6), k, day(rng.randint(0, 3000))) for k in range(60)] + [(None, 60, day(1)), (1, 61, None), (1, None, day(2900))]
    names = ["I10", "I1", 'a"b', "x,y", "é\U0001f600", "E11", "Z", None]
    seen = [(rng.randint(1, 6), rng.choice(names), rng.choice([9, 10]), day(rng.randint(0, 3000))) for _ in range(150)]
    seen += [(1, "never", 9, None), (99, "other", 10, day(1))]
    visits = spark.createDataFrame(stays, "subject_id long, stay_id long, intime timestamp_ntz")
    dated = spark.createDataFrame(seen, "subject_id long, icd_code string, icd_version int, dischtime timestamp_ntz")
    to9, to10 = {"I10": "4019", "E11": "25000"}, {"Z": "I10"}
    maps = {
        "10to9": spark.createDataFrame(list(to9.items()), "source_code string, target_code string"),
        "9to10": spark.createDataFrame(list(to10.items()), "source_code string, target_code string"),
    }
    wanted = {
        "v9": lambda c, v: to9.get(c, c) if v == 10 else c,
        "v9_3digit": lambda c, v: to9.get(c, c)[:3] if v == 10 else c,
        "v10": lambda c, v: to10.get(c, c) if v == 9 else c,
    }
    recent = lambda s, k, t: [
        (c, v) for e, c, v, u in seen if None not in (s, k, t, c, u) and e == s and u < t <= u + timedelta(days=codes.LOOKBACK_DAYS)
    ]
    for rows in (codes.BROADCAST_ROWS, 0):
        monkeypatch.setattr(codes, "BROADCAST_ROWS", rows)
        for variant, (got, index) in codes.lookback_lists(visits, dated, maps, list(wanted)).items():
            expected = {k: sorted({wanted[variant](c, v) for c, v in recent(s, k, t)}) for s, k, t in stays}
            number = {c: i for i, c in enumerate(sorted({c for found in expected.values() for c in found}))}
            assert {r["code"]: r["code_idx"] for r in index.collect()} == number
            lists = [(r["stay_id"], r["icd_list"], r["icd_encoded_list"]) for r in got.collect()]
            assert len(lists) == len(stays)
            assert {k: (c, i) for k, c, i in lists} == {k: (c, [number[x] for x in c]) for k, c in expected.items()}
            if rows:
                plan = got._jdf.queryExecution()
                assert "Exchange" not in plan.executedPlan().toString()
                assert "from_json" not in plan.optimizedPlan().toString()
