"""Filters as data: what is asked for reaches the scan of partitioned Parquet."""

import re
from datetime import datetime

import pytest

from arenaflow.functions.filters import Spec, clamped, where, window

NOW = datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def matches(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("f") / "m")
    rows = [(i, "1on1" if i % 2 else "2on2", f"dm{i % 5}", datetime(2023 + i % 2, 1 + i % 12, 3), i % 7, [None, True, False][i % 3]) for i in range(200)]
    spark.createDataFrame(rows, "id long, mode string, arena string, at timestamp_ntz, frags int, hidden boolean").write.partitionBy("mode").parquet(path)
    return spark.read.parquet(path), rows


def scan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k: (re.search(rf"{k}: \[(.*?)\](, |$)", plan) or ["", ""])[1] for k in ("PushedFilters", "PartitionFilters")}


@pytest.mark.parametrize("spec,parts,pushed", [
    (Spec(equal={"mode": "1on1"}), ["mode"], []),
    (Spec(equal={"arena": "dm1"}), [], ["EqualTo(arena,dm1)"]),
    (Spec(equal={"arena": ["dm1", "dm2"]}), [], ["In(arena"]),
    (Spec(at="at", now=NOW, days=90), [], ["GreaterThanOrEqual(at", "LessThan(at"]),
    (Spec(at="at", since=datetime(2024, 3, 1)), [], ["GreaterThanOrEqual(at"]),
    (Spec(at_least={"frags": 3}), [], ["GreaterThanOrEqual(frags,3)"]),
    (Spec(hidden="hidden"), [], ["Or(IsNull(hidden)"]),
    (Spec(equal={"mode": "2on2", "arena": "dm4"}, at="at", now=NOW, days=400, at_least={"frags": 1}, hidden="hidden"), ["mode"], ["EqualTo(arena,dm4)", "GreaterThanOrEqual(frags,1)", "LessThan(at"]),
])
def test_every_filter_is_pushed(matches, spec, parts, pushed):
    df = where(matches[0], spec)
    found = scan(df)
    assert all(p in found["PartitionFilters"] for p in parts) and all(p in found["PushedFilters"] for p in pushed), found
    assert df.count() == sum(keeps(r, spec) for r in matches[1])


def keeps(row, spec):
    r = dict(zip(("id", "mode", "arena", "at", "frags", "hidden"), row))
    ok = all(r[c] in (v if isinstance(v, list) else [v]) for c, v in spec.equal.items() if v is not None) and all(r[c] >= v for c, v in spec.at_least.items())
    if spec.days:
        low, high = window(spec.now, spec.days, spec.shift)
        ok = ok and low <= r["at"] < high
    return ok and (not spec.since or r["at"] >= spec.since) and not (spec.hidden and r["hidden"])


def test_what_isnt_asked_for_filters_nothing(matches):
    assert where(matches[0], Spec(equal={"mode": None, "arena": None}, at="at", at_least={"frags": None})).count() == 200
    assert where(matches[0], Spec(equal={"arena": []})).count() == 0


@pytest.mark.parametrize("shift", ["current", "prior", "year_ago"])
def test_shifted_windows(matches, shift):
    spec = Spec(at="at", now=NOW, days=120, shift=shift)
    assert where(matches[0], spec).count() == sum(keeps(r, spec) for r in matches[1])
    low, high = window(NOW, 120, shift)
    assert (high - low).days == 120 and (NOW - high).days == {"current": 0, "prior": 120, "year_ago": 365}[shift]


def test_least_number_of_matches():
    assert [clamped(x) for x in (None, 0, 3, 9)] == [5, 5, 5, 9]
