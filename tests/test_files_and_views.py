import random
import tempfile
from dataclasses import replace
from pathlib import Path

import pytest
from helpers import outcome, request, table
from pyspark.sql import functions as F

from concordat.operators import results as views
from concordat.operators.compare import reconcile
from concordat.sources.delimited import describe_side, infer_types, malformed_rows, read_side
from concordat.sources.jsonfields import discover, resolve, split_path
from concordat.sources.sink import export_csv, load_run, load_selection, page_saved, save_run, save_selection, search_saved
from concordat.spec import Pair, ReconError, ReconSpec


def write(content: bytes) -> str:
    folder = Path(tempfile.mkdtemp(prefix="concordat-test-"))
    (folder / "x.csv").write_bytes(content)
    return str(folder / "x.csv")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scans(spark):
    assert rows(read_side(spark, write(b"name;age;city\nAnn;;Bonn\n"))) == [("Ann", "", "Bonn")]
    quoted = b'"a;b;c","x, y"\n" 1 ","say ""hi""\nthere"\n'
    found = read_side(spark, write(quoted))
    assert found.columns == ["a;b;c", "x, y"] and rows(found) == [(" 1 ", 'say "hi"\nthere')]
    assert rows(read_side(spark, write("﻿id,v\n1,é\n".encode()))) == [("1", "é")]
    assert rows(read_side(spark, write("﻿id;v\n1;é\n".encode("utf-16-le")))) == [("1", "é")]
    with pytest.raises(ReconError, match="Row 3 has 2 columns, expected 3 columns"):
        read_side(spark, write(b"a,b,c\n1,2,3\n1,2\n4\n"))
    short = write(b"a,b,c\n1,2,3\n1,2\n")
    assert rows(read_side(spark, short, strict=False)) == [("1", "2", "3")] and rows(malformed_rows(spark, short)) == [("1,2",)]
    with pytest.raises(ReconError, match="Duplicate CSV headers are not supported: name"):
        read_side(spark, write(b"name,v,name\n1,2,3\n"))
    with pytest.raises(ReconError, match="empty"):
        read_side(spark, write(b""))


def test_headers_of_any_length(spark):
    names = [f"a rather long name of column {i}" for i in range(2_200)]
    assert len(",".join(names)) > 1 << 16
    assert read_side(spark, write(",".join(names).encode() + b"\n"), strict=False).columns == names
    broken = "\n\n" + '"a\n\nb\nc\nd";"x ""y""";z\n1;2;3\n'
    for text in (broken.encode(), "\ufeff".encode() + broken.encode(), broken.encode()[:-1]):
        found = read_side(spark, write(text), sep=";")
        assert found.columns == ["a\n\nb\nc\nd", 'x "y"', "z"] and rows(found) == [("1", "2", "3")]
    for kind in ("utf-16-le", "utf-16-be"):
        found = read_side(spark, write("\ufeff\u0a0a,\u010a\n\u0a0d,é\n".encode(kind)))
        assert found.columns == ["\u0a0a", "\u010a"] and rows(found) == [("\u0a0d", "é")]
    folder = tempfile.mkdtemp(prefix="concordat-test-")
    for name, text in (("0", b""), ("1", b"id,v\n1,x\n"), ("2", b"id,v\n2,y\n3,z,\n")):
        Path(f"{folder}/{name}.csv").write_bytes(text)
    assert sorted(rows(read_side(spark, folder, strict=False))) == [("1", "x"), ("2", "y")]
    with pytest.raises(ReconError, match="Row 3 has 3 columns, expected 2 columns"):
        read_side(spark, folder, multiline=False)


def test_types(spark):
    cells = [("1", "1.5", "2026-01-02", "x", ""), ("2", "2", "1/2/2026", "1", ""), ("-3", "1e3", "02/03/2026", "2", ""), ("+4", "inf", "2026-1-1", "3", ""), ("5", "7", "-", "4", "")]
    assert [r["data_type"] for r in infer_types(table(spark, "i f d s e", cells).drop("_n")).orderBy("index").collect()] == ["integer", "float", "date", "integer", "string"]


def test_json_fields(spark):
    cells = [("1", '{"high":1,"nested":{"flag":true,"a.b":"x"},"list":[1,{"z":1}]}'), ("2", "not json"), ("3", "[1]")]
    df = table(spark, "id metrics", cells).drop("_n")
    labels = [r["label"] for r in discover(df).collect()]
    assert labels == ["metrics.high", "metrics.list", "metrics.nested", "metrics.nested.a\\.b", "metrics.nested.flag"]
    assert {r["name"] for r in describe_side(df).collect()} >= {"id", "metrics.high"}
    assert split_path("a\\.b.c") == ["a.b", "c"] and split_path("a..b") is None
    assert resolve(["metrics", "metrics.high"], "metrics.high") == ("metrics.high", None)
    assert resolve(["m", "m.c"], "m#c") == ("m", ["c"]) and resolve(["m.c"], "m.c#x.y") == ("m.c", ["x", "y"]) and resolve(["m"], "q.c") is None
    a = table(spark, "id j", [("1", '{"k":42,"f":1.0,"t":true,"o":{"b":1,"a":[2]}}'), ("2", "not json")])
    b = table(spark, "id j", [("1", '{"o":{"a":[2],"b":1},"k":"42","f":1.0,"t":true}'), ("2", '{"k":null}')])
    spec = ReconSpec(("id",), ("id",), ("j.k", "j.f", "j.t", "j.o"), ("j.k", "j.f", "j.t", "j.o"), order_a=("_n",), order_b=("_n",))
    assert [t for t, _ in outcome(a, b, spec)] == ["match", "match"]
    unknown = ReconSpec(("id",), ("id",), ("j.k", "j.nope"), ("j.k", "j.nope"), order_a=("_n",), order_b=("_n",))
    with pytest.raises(ReconError, match="File A: no cell holds the fields j.nope"):
        outcome(a, b, unknown)
    assert [t for t, _ in outcome(a, b, replace(unknown, check_fields=False))] == ["match", "match"]


def test_saved_selection(spark):
    spec = ReconSpec(("id",), ("ident",), ("v",), ("w",), (Pair("v", "w", "fuzzy", 0.9),))
    folder = f"{tempfile.mkdtemp(prefix='concordat-test-')}/selection"
    save_selection(spark, spec, ["id", "v"], ["ident", "w"], folder)
    assert load_selection(spark, folder, ["v", "id"], ["w", "ident"]) == spec
    with pytest.raises(ReconError, match="missing: v; unexpected: u"):
        load_selection(spark, folder, ["u", "id"], ["w", "ident"])


def sample(spark):
    a = table(spark, "id region v", [("1", "N", "x"), ("2", "N", "y"), ("3", "S", "p"), ("3", "S", "q,r"), ("", "W", "i"), ("10", "E", "only")])
    b = table(spark, "ident region w", [("1", "N", "x"), ("2", "N", "z"), ("3", "S", "p"), ("7", "Q", "late")])
    spec = ReconSpec(("id", "region"), ("ident", "region"), ("v",), ("w",), order_a=("_n",), order_b=("_n",))
    return reconcile(a, b, spec), spec


def test_export_and_saved_runs(spark):
    run, spec = sample(spark)
    folder = tempfile.mkdtemp(prefix="concordat-test-")
    export_csv(run.results, spec, f"{folder}/csv", single_file=True)
    text = next(Path(f"{folder}/csv").glob("part-*")).read_text().splitlines()
    assert text[0] == "Result,Key: id / ident,Key: region,File A: v,File B: w,Difference Summary,Duplicate Rows File A,Duplicate Rows File B,Duplicate Summary"
    assert "Mismatch,2,N,y,z,v -> w: y -> z,,," in text and "Ignored in File A,,W,i,,,,," in text and "Only in File B,7,Q,,late,,,," in text
    assert 'Duplicate (File A),3,S,,,,"[[""p""],[""q,r""]]",,"File A: [p] | [q,r]"' in text
    save_run(run, f"{folder}/run")
    results, summary, loaded = load_run(spark, f"{folder}/run")
    assert loaded == spec and summary.first()["duplicates_a"] == 1 and results.count() == run.results.count()
    summary.withColumn("matches", F.lit(9).cast("long")).write.parquet(f"{folder}/bad/summary")
    for part in ("results", "spec", "columns_a", "columns_b"):
        Path(f"{folder}/bad/{part}").symlink_to(f"{folder}/run/{part}")
    with pytest.raises(ReconError, match="matches"):
        load_run(spark, f"{folder}/bad")


def test_pages_and_searches_of_saved_runs(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "x", "", "50%", "naïve 𝒳y", "a b", "late"]
    rows_of = lambda n: [(str(rng.randrange(n)), rng.choice(words), rng.choice(words)) for _ in range(n)]
    a, b = table(spark, "id v w", rows_of(300)), table(spark, "id v w", [*rows_of(250), ("N/A", "x", "late")])
    spec = ReconSpec(("id",), ("id",), ("v", "w"), ("v", "w"), order_a=("_n",), order_b=("_n",))
    run = reconcile(a, b, spec)
    folder = f"{tempfile.mkdtemp(prefix='concordat-test-')}/run"
    save_run(run, folder, ranges=7, searchable=True)
    every = [r["key"] for r in run.ordered.collect()]
    for size, start in ((40, 33), (len(every), 0), (50, len(every) - 9), (5, len(every))):
        assert [r["key"] for r in page_saved(spark, folder, size, start).collect()] == every[start : start + size]
    results, _, _ = load_run(spark, folder)
    for name in views.BUCKETS[1:]:
        own = [r["key"] for r in views.filter_results(run.results, name).orderBy("_order").collect()]
        assert views.filter_results(results, name).count() == len(own)
        for size, start in ((20, 7), (len(own) + 1, 0)):
            assert [r["key"] for r in page_saved(spark, folder, size, start, name).collect()] == own[start : start + size]
    plan = page_saved(spark, folder, 3, 20, "mismatch")._jdf.queryExecution().executedPlan().toString()
    parted = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in parted and "part" in parted and "GreaterThanOrEqual(_seat" in plan
    stored = results.cache()
    tried = [(" LATE ", "all"), ("50%", "fileB"), ("ve 𝒳y", "all"), ("𝒳y", "fileA"), ("only in", "type"), ("v w", "all"), ("nowhere", "all"), ("late", "key"), ("", "all")]
    for query, field in tried:
        seen, scanned = search_saved(spark, folder, query, field), views.search_results(stored, query, field, spec)
        assert sorted(r["key"] for r in seen.collect()) == sorted(r["key"] for r in scanned.collect()), (query, field)
    stored.unpersist()
    with pytest.raises(ReconError):
        page_saved(spark, folder, 3, 0, "nope")
    empty = f"{folder}-empty"
    save_run(reconcile(a.limit(0), b.limit(0), spec), empty, searchable=True)
    assert page_saved(spark, empty).count() == 0 == search_saved(spark, empty, "late").count() and load_run(spark, empty)[1].first()["matches"] == 0


def test_views(spark):
    run, spec = sample(spark)
    results = run.results
    counts = {r["bucket"]: r["n"] for r in views.facet_counts(results).collect()}
    assert counts == {"all": 6, "match": 1, "mismatch": 1, "missing_left": 1, "missing_right": 1, "unkeyed_left": 0, "unkeyed_right": 1, "duplicate": 1}
    assert views.filter_results(results, "duplicate").count() == 1
    keys = lambda df: [r["key"][0] for r in df.collect()]
    assert keys(views.search_results(results, " LATE ")) == ["7"] and keys(views.search_results(results, "late", "fileA")) == []
    assert keys(views.search_results(results, "%")) == [] and sorted(keys(views.search_results(results, "only in", "type"))) == ["10", "7"]
    assert keys(views.sort_results(results, "key")) == ["", "1", "2", "3", "7", "10"]
    assert keys(views.page(results, 2, 1, "key")) == ["1", "2"] and keys(views.sort_results(results, "details", False))[0] == "2"
    with pytest.raises(ReconError):
        views.filter_results(results, "nope")
    assert rows(views.difference_rows(results)) == [("mismatch", ["2", "N"], "v", "w", "y", "z")]
    assert views.paired_values(results, spec).where("result_type = 'duplicate_file_a'").count() == 2
    seen = views.overview(run.summary()).first()
    assert (seen["comparable_total"], seen["match_percent"], seen["matches_share"]) == (4, 25, "25% of comparable rows")
    assert seen["ignored_notice"] == "1 in File A, 0 in File B" and seen["duplicate_notice"] == "Duplicates found: 1 in File A, 0 in File B"
