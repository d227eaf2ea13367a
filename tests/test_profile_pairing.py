import pytest
from helpers import table

from concordat.functions.names import jaro_winkler, normal_name
from concordat.operators.pairing import auto_pair, suggest_by_name, suggest_pairs
from concordat.operators.profile import profile, values_of
from concordat.spec import Pair, ReconError


def named(a, b):
    return [(p.a, p.b, p.kind) for p in suggest_by_name(a, b)]


def test_names():
    assert named(["Name", "Age", "City"], ["name", "age", "location"]) == [("Name", "name", "exact"), ("Age", "age", "exact")]
    assert named(["alpha_num_code"], ["alpha_number_code"]) == [("alpha_num_code", "alpha_number_code", "fuzzy")]
    assert named(["FirstName"], ["first_name"]) == [("FirstName", "first_name", "exact")]
    assert len(named(["left_key", "right_key"], ["left_right_key"])) == 1
    found = suggest_by_name(["full_name", "email_address"], ["display_name", "email"])
    assert {(p.a, p.b) for p in found} == {("full_name", "display_name"), ("email_address", "email")} and all(p.similarity >= 0.9 for p in found)
    assert named(["first_name"], ["last_name"]) == []
    assert normal_name("  orderID2Name__x") == "order id2 name x"
    assert round(jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611 and round(jaro_winkler("DIXON", "DICKSONX"), 4) == 0.8133


def test_values(spark):
    rows = [(f"id-{i}", f"Label {i}", f"g{i}", "yes" if i % 2 else "no", "1") for i in range(6)]
    a = table(spark, "source_id display_label group_label status_flag score_bucket", rows).drop("_n")
    b = table(spark, "external_key public_name category_name lifecycle_state rank_value", [(r[0], r[1].upper(), r[2] + " ", r[3], "7") for r in rows]).drop("_n")
    found = {(p.a, p.b): p.similarity for p in suggest_pairs(a, b)}
    assert set(found) == {("source_id", "external_key"), ("display_label", "public_name"), ("group_label", "category_name")}
    assert min(found.values()) >= 0.85


def test_profile(spark):
    cells = [("7", "A  b", "1.5"), ("8", " a B", "2"), ("", "null", "x"), ("9", "123e4567-e89b-12d3-a456-426614174000", None)]
    found = {r["col"]: r for r in profile(values_of(table(spark, "i t d", cells), ["i", "t", "d"])).collect()}
    assert (found["i"]["kind"], found["i"]["unique_values"], found["i"]["non_empty"]) == ("integer", 3, 3)
    assert (found["t"]["kind"], found["t"]["unique_values"], found["t"]["non_empty"]) == ("text", 2, 3)
    assert found["d"]["non_empty"] == 3


def test_auto_pair():
    pairs = [Pair("id", "key", "exact", 1.0), Pair("b", "x", "fuzzy", 0.9), Pair("a", "y", "exact", 0.98), Pair("c", "z", "fuzzy", 0.8)]
    spec = auto_pair(pairs, ["id"], ["key"], ["id", "a", "b", "c"], ["key", "x", "y", "z"])
    assert (spec.values_a, spec.values_b) == (("a", "b"), ("y", "x"))
    assert auto_pair(pairs, ["id"], ["key"], ["id", "a", "b", "c"], ["key", "x", "y", "z"], "b").values_b == ("x", "y")
    for keys in ((), ("id", "a")):
        with pytest.raises(ReconError):
            auto_pair(pairs, keys, ("key",), ["id", "a", "b", "c"], ["key", "x", "y", "z"])
    with pytest.raises(ReconError):
        auto_pair(pairs[3:], ["id"], ["key"], ["id", "c"], ["key", "z"])
