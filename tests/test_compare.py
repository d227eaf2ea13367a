import random
from datetime import date, datetime

import pytest
from helpers import outcome, request, table
from pyspark.sql import functions as F

from concordat.functions import normalize
from concordat.operators.compare import reconcile
from concordat.spec import Normalization, Pair, ReconError, ReconSpec


def test_basic_duplicates_and_one_sided(spark):
    a = table(spark, "id name value", [("1", "x", "10"), ("2", "y", "20"), ("2", "y", "21"), ("3", "z", "30")])
    b = table(spark, "id name amount", [("1", "x", "10"), ("2", "y", "20"), ("4", "w", "40")])
    run = reconcile(a, b, request("id", values_a="name value", values_b="name amount"))
    rows = {r["key"][0]: r for r in run.results.collect()}
    assert {k: r["result_type"] for k, r in rows.items()} == {"1": "match", "2": "duplicate_file_a", "3": "missing_right", "4": "missing_left"}
    assert rows["2"]["duplicate_values_a"] == [["y", "20"], ["y", "21"]] and rows["2"]["duplicate_values_b"] == []
    assert rows["2"]["values_a"] == [] and rows["1"]["values_b"] == ["x", "10"]
    counts = run.summary().first().asDict()
    assert counts == {
        "total_rows_a": 4, "total_rows_b": 3, "matches": 1, "mismatches": 0, "missing_left": 1, "missing_right": 1,
        "unkeyed_left": 0, "unkeyed_right": 0, "duplicates_a": 1, "duplicates_b": 0,
    }


def test_duplicates_on_b_and_both(spark):
    a = table(spark, "id v", [("8", "1"), ("9", "1"), ("9", "2")])
    b = table(spark, "id v", [("8", "1"), ("8", "2"), ("9", "3"), ("9", "4")])
    run = reconcile(a, b, request("id", values_a="v"))
    rows = {r["key"][0]: r for r in run.results.collect()}
    assert rows["8"]["result_type"] == "duplicate_file_b" and rows["8"]["duplicate_values_a"] == []
    assert rows["9"]["result_type"] == "duplicate_both" and rows["9"]["duplicate_values_b"] == [["3"], ["4"]]
    counts = run.summary().first()
    assert (counts["duplicates_a"], counts["duplicates_b"]) == (1, 2)


def test_order(spark):
    a = table(spark, "id v", [("c", ""), ("a", ""), ("", ""), ("b", "")])
    b = table(spark, "id v", [("a", ""), ("b", ""), ("na", ""), ("d", "")])
    found = outcome(a, b, request("id", values_a="v"))
    assert found == [
        ("unkeyed_right", ("",)), ("unkeyed_left", ("na",)), ("missing_right", ("c",)), ("match", ("a",)), ("match", ("b",)), ("missing_left", ("d",)),
    ]


def test_unusable_keys_are_never_duplicates(spark):
    a = table(spark, "id v", [(" ", "1"), ("NULL", "2"), ("1", "3"), (None, "4")])
    b = table(spark, "id v", [("", "1"), ("1", "3")])
    found = [t for t, _ in outcome(a, b, request("id", values_a="v", rules={"trim": True}))]
    assert sorted(found) == ["match", "unkeyed_left", "unkeyed_right", "unkeyed_right", "unkeyed_right"]


def test_crossed_pairs_and_differences(spark):
    a = table(spark, "id first nick", [("1", "Ann", ""), ("2", "Bob", "B")])
    b = table(spark, "id alias full", [("1", "null", "Ann"), ("2", "Bo", "Bob")])
    spec = ReconSpec(("id",), ("id",), ("first", "nick"), ("alias", "full"), (Pair("first", "full"), Pair("nick", "alias")))
    rows = {r["key"][0]: r for r in reconcile(a, b, spec).results.collect()}
    assert rows["1"]["result_type"] == "match" and rows["1"]["values_b"] == ["null", "Ann"]
    assert [tuple(d) for d in rows["2"]["differences"]] == [("nick", "alias", "B", "Bo")]


CASES = [
    ({"numbers": True}, "100", "100.0", True), ({"numbers": True}, "100", "100.01", False), ({}, "0100.00", "+100.0", False), ({}, "100.00", "100.0", False),
    ({"numbers": True}, "-0", "0.00", True), ({"numbers": True}, "000123456789012345678901234567890.50", "+123456789012345678901234567890.5", True),
    ({}, '{"a":1,"b":2}', '{"b":2,"a":1}', True), ({}, '{"a":[2,3]}', '{"a":[2,4]}', False), ({}, '{"a":1', '{"a":1 ', False), ({}, '{"a":1} x', '{"a":1}  x', False),
    ({"decimals": 0}, "100.4", "100.6", False), ({"decimals": 2}, "100", "100.000", True), ({"decimals": 2}, "100.22", "100", True),
    ({"decimals": 2}, "100.234", "100.2", True), ({"decimals": 3}, "1.5", "1.50", False), ({"decimals": 2}, "99.995", "100", True), ({"decimals": 0}, "-0.4", "0", True),
    ({"decimals": 0}, "-99.5", "-100", True), ({"decimals": 0, "trim": True}, " 100.4 ", "100.49", True), ({}, "NA", "None", True), ({"null_any_case": False}, "NA", "None", False),
    ({"dates": True, "date_formats": ("%Y-%m-%d", "%d/%m/%Y")}, "2026-04-13", "13/04/2026", True), ({"dates": True, "date_formats": ()}, "18-FEB-19", "2019-02-18", True),
    ({"dates": True, "date_formats": ()}, "18-feb-85", "1985-02-18", True), ({"dates": True, "date_formats": ("%Y%m%d", "%Y-%m-%d")}, "20260413", "2026-04-13", True),
    ({"dates": True}, "31/02/2026", "2026-02-31", False), ({"trim": True}, " x\t", "x", True), ({}, " x", "x", False), ({"any_case": True}, "Éa", "éA", True),
    ({"empty_is_null": False}, "", "null", False), ({"use_null_tokens": False}, "na", "NA", False), ({}, "", "n/a", True),
]


def test_clean_up(spark):
    for rules in {repr(c[0]): c[0] for c in CASES}.values():
        own = [c for c in CASES if c[0] == rules]
        a = table(spark, "id v", [(f"k{i}x", c[1]) for i, c in enumerate(own)])
        b = table(spark, "id v", [(f"k{i}x", c[2]) for i, c in enumerate(own)])
        found = outcome(a, b, request("id", values_a="v", rules=rules))
        assert [t == "match" for t, _ in found] == [c[3] for c in own], (rules, own, found)


def test_dates(spark):
    """Each format reads what it prints and nothing else."""
    days = [date(1970, 1, 1), date(1999, 12, 31), date(2024, 2, 29), date(2023, 3, 1), date(2069, 5, 9), *(date(2021, m, 7 + m) for m in range(1, 13))]
    formats = [
        "%F", "%D", "%x", "%v", "%e.%m.%Y", "%Y-%j", "%Y%j", "%h %d, %Y", "%A, %d %B %Y", "%a %d %b %y", "%Y-%m-%dT%H:%M:%S", "%F %I:%M %p", "%c", "%d/%m/%Y %R",
        "%Y.%m.%d %T%.f", "%F%%", "%d%b%Y", "%Y%m%d", "%F %j",
    ]
    printed = lambda d, f: datetime(d.year, d.month, d.day, 14, 5, 9).strftime(f.replace("%v", "%e-%b-%Y").replace("%.f", ".25"))
    for part in (formats[:10], formats[10:]):
        cells = spark.createDataFrame([(f, printed(d, f), d.isoformat()) for f in part for d in days], "f string, cell string, day string")
        read = F.coalesce(*(F.when(F.col("f") == f, normalize.iso_date(F.col("cell"), [f])) for f in part))
        assert [tuple(r) for r in cells.withColumn("read", read).where("read is distinct from day").collect()] == []
    wrong = [
        ("%F", "2023-02-29"), ("%F", "2023-02-28\n"), ("%F", " 2023-02-28"), ("%a %F", "Mon 2023-02-28"), ("%Y-%j", "2023-366"), ("%Y-%j", "2023-000"), ("%F %R", "2023-02-28 24:00"),
        ("%F %I", "2023-02-28 13"), ("%d %b %Y", "3 Foo 2023"), ("%F %j", "2023-02-28 060"), ("%FT", "2023-02-28t"), ("%F", ""), ("%Y-%m", "2023-02"),
    ]
    one = spark.range(1).select(*(normalize.iso_date(F.lit(cell), [f]).alias(f"c{i}") for i, (f, cell) in enumerate(wrong)))
    assert set(one.first()) == {None}
    a = table(spark, "id v", [("1", "1")])
    for bad in ("%Y-%m-%d %Q", "%Y-%m-%d %"):
        with pytest.raises(ReconError, match="unknown directive"):
            reconcile(a, a, request("id", values_a="v", rules={"dates": True, "date_formats": (bad,)}))


def test_clean_up_of_keys_and_display(spark):
    a = table(spark, "id v", [("  AbC  ", "1"), ("100.4", "2")])
    b = table(spark, "id v", [("abc", "1"), ("100.49", "2")])
    assert outcome(a, b, request("id", values_a="v", rules={"trim": True, "any_case": True, "decimals": 0})) == [("match", ("  AbC  ",)), ("match", ("100",))]
    run = reconcile(table(spark, "id v", [("1", "100.4")]), table(spark, "id v", [("1", "100.6")]), request("id", values_a="v", rules={"decimals": 0}))
    row = run.results.first()
    assert row["values_a"] == ["100"] and row["differences"][0]["value_b"] == "101"


def test_swapping_sides_and_shuffling_rows(spark):
    rng = random.Random(3)
    rows = lambda: [(rng.choice(["", "a", "b", "c", "d", "e", "f", "g"]), rng.choice("xy")) for _ in range(30)]
    x, y = rows(), rows()
    spec = request("id", values_a="v")
    one = reconcile(table(spark, "id v", x), table(spark, "id v", y), spec).summary().first().asDict()
    two = reconcile(table(spark, "id v", rng.sample(y, 30)), table(spark, "id v", rng.sample(x, 30)), spec).summary().first().asDict()
    swap = {"total_rows_a": "total_rows_b", "missing_left": "missing_right", "unkeyed_left": "unkeyed_right", "duplicates_a": "duplicates_b"}
    swap |= {v: k for k, v in swap.items()}
    assert one == {k: two[swap.get(k, k)] for k in one}


def test_requests_that_cannot_be_used(spark):
    a = table(spark, "id v", [("1", "1")])
    for bad in (
        ReconSpec((), ("id",)), ReconSpec(("id",), ("id", "v")), ReconSpec(("id",), ("id",), ("v",), ()), ReconSpec(("id", "id"), ("id", "v")),
        ReconSpec(("id",), ("id",), ("v",), ("v",), (Pair("id", "v"),)), ReconSpec(("id",), ("id",), ("v",), ("v",), (Pair("v", "v", "fuzzy", 2.0),)),
        ReconSpec(("nope",), ("id",)),
    ):
        with pytest.raises(ReconError):
            reconcile(a, a, bad)
    spec = request("id", values_a="v", rules={"numbers": True})
    assert ReconSpec.from_dict(spec.to_dict()) == spec
    assert Normalization.from_dict({"trim": True}).use_null_tokens
    spec.check(["v", "id"], ["id"], ["id", "v"], ["id"])
    with pytest.raises(ReconError, match=r"missing: v \(x2\)"):
        spec.check(["id"], ["id"], ["id", "v", "v"], ["id"])


def test_empty_tables(spark):
    empty, one = table(spark, "id v", []), table(spark, "id v", [("1", "1")])
    assert outcome(empty, empty, request("id", values_a="v")) == []
    assert outcome(empty, one, request("id", values_a="v")) == [("missing_left", ("1",))]
    assert reconcile(empty, empty, request("id", values_a="v")).summary().first()["matches"] == 0
