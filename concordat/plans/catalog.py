"""Registered queries over the given tables, and the SQL that checks them.

Side A is a table as text; side B is derived from it row by row: rows lost and added, repeated, their keys made
unusable, and cells written in other ways.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators import results as views
from concordat.operators.compare import Reconciliation, reconcile
from concordat.operators.graph import set_folder
from concordat.operators.pairing import suggest_pairs
from concordat.operators.profile import overlap, profile, values_of
from concordat.sources.delimited import infer_types
from concordat.sources.jsonfields import discover
from concordat.sources.sink import difference_text, duplicate_json, duplicate_text, export_rows, page_saved, save_run, search_saved
from concordat.spec import Normalization, Pair, ReconSpec

VALUES = ("status", "price", "odate")
SPEC = ReconSpec(("k",), ("k",), VALUES, VALUES, order_a=("n",), order_b=("n",), json_equality=False)


def orders_a(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("n"),
        F.col("o_orderkey").cast("string").alias("k"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("odate"),
        F.col("o_orderpriority").alias("prio"),
    )


def orders_b(spark: SparkSession, sf: str) -> DataFrame:
    a, n = orders_a(spark, sf), F.col("n")
    changed = a.where(n % 17 != 0).select(
        n,
        F.when(n % 29 == 0, "N/A").otherwise(F.col("k")).alias("k"),
        F.when(n % 5 == 0, F.lower("status")).otherwise(F.col("status")).alias("status"),
        F.when(n % 11 == 0, (F.col("price").cast("decimal(18,2)") + F.lit("0.01").cast("decimal(18,2)")).cast("decimal(18,2)").cast("string")).otherwise(F.col("price")).alias("price"),
        F.when(n % 3 == 0, F.date_format(F.to_date("odate"), "dd/MM/yyyy")).otherwise(F.col("odate")).alias("odate"),
        "prio",
    )
    copies = F.concat(F.array(F.struct((4 * n).alias("n"), F.col("k").alias("k"))), F.when(n % 23 == 0, F.array(F.struct((4 * n + 1).alias("n"), F.col("k").alias("k")))).otherwise(F.array()))
    added = F.when(n % 19 == 0, F.array(F.struct((4 * n + 2).alias("n"), (n + 10**9).cast("string").alias("k")))).otherwise(F.array())
    return changed.select(F.explode(F.concat(copies, added)).alias("x"), "status", "price", "odate", "prio").select("x.*", "status", "price", "odate", "prio")


AB = """
a as (
  select o_orderkey as n, cast(o_orderkey as varchar) as k, o_orderstatus as status, cast(cast(o_totalprice as decimal(18,2)) as varchar) as price,
    strftime(o_orderdate, '%Y-%m-%d') as odate, o_orderpriority as prio, o_orderdate as d
  from orders
),
b0 as (
  select n, case when n % 29 = 0 then 'N/A' else k end as k, case when n % 5 = 0 then lower(status) else status end as status,
    case when n % 11 = 0 then cast(cast(price as decimal(18,2)) + 0.01 as varchar) else price end as price,
    case when n % 3 = 0 then strftime(d, '%d/%m/%Y') else odate end as odate, prio
  from a where n % 17 <> 0
),
b as (
  select 4 * n as n, k, status, price, odate, prio from b0
  union all select 4 * n + 1, k, status, price, odate, prio from b0 where n % 23 = 0
  union all select 4 * n + 2, cast(n + 1000000000 as varchar), status, price, odate, prio from b0 where n % 19 = 0
)"""


def resolved_sql(sides: str = AB, status: str = "{}.status", price: str = "{}.price", odate: str = "{}.odate", shown: str = "{}.price") -> str:
    """CTEs up to r: one row for each result, with the compared cells given by expressions of a side's row."""
    apart = [f"{x.format('x')} is distinct from {x.format('y')}" for x in (status, price, odate)]
    show = ["{}.status", shown, "{}.odate"]
    line = " || '; ' || ".join(
        f"coalesce(case when {t} then '{c}: ' || {s.format('x')} || ' -> ' || {s.format('y')} end, '')" for t, c, s in zip(apart, VALUES, show, strict=True)
    )
    cells = lambda s: " || '|' || ".join(x.format(s) for x in show)
    return f"""{sides},
ga as (select k, count(*) as c, min(n) as f from a group by k),
gb as (select k, count(*) as c, min(n) as f from b where lower(k) not in ('', 'null', 'na', 'n/a', 'none') group by k),
m as (select coalesce(ga.k, gb.k) as k, coalesce(ga.c, 0) as ca, coalesce(gb.c, 0) as cb, ga.f as fa, gb.f as fb from ga full join gb on ga.k = gb.k),
r as (
  select
    case when cb > 1 then 'duplicate_file_b' when ca = 0 then 'missing_left' when cb = 0 then 'missing_right'
      when {" or ".join(apart)} then 'mismatch' else 'match' end as result_type,
    m.k as key,
    case when cb > 1 or ca = 0 then '' else {cells("x")} end as values_a,
    case when cb > 1 or cb = 0 then '' else {cells("y")} end as values_b,
    case when ca = 1 and cb = 1 then trim(regexp_replace(regexp_replace({line}, '^(; )+|(; )+$', '', 'g'), '(; )+', '; ', 'g')) else '' end as differences
  from m left join a x on x.n = m.fa left join b y on y.n = m.fb
  union all
  select 'unkeyed_left', y.k, '', {cells("y")}, '' from b y where lower(y.k) in ('', 'null', 'na', 'n/a', 'none')
)"""


def flat(results: DataFrame) -> DataFrame:
    join = lambda c: F.array_join(c, "|").alias(c)
    return results.select("result_type", join("key"), join("values_a"), join("values_b"), difference_text().alias("differences"))


def orders_run(spark: SparkSession, sf: str, **rules) -> Reconciliation:
    return reconcile(orders_a(spark, sf), orders_b(spark, sf), replace(SPEC, normalization=Normalization(**rules)))


def recon_exact_default(spark, sf):
    return flat(orders_run(spark, sf).results)


def recon_summary(spark, sf):
    return orders_run(spark, sf).summary()


def recon_facets(spark, sf):
    return views.facet_counts(orders_run(spark, sf).results)


def recon_overview(spark, sf):
    return views.overview(orders_run(spark, sf).summary())


def recon_case_trim(spark, sf):
    return flat(orders_run(spark, sf, any_case=True, trim=True).results)


def recon_dates(spark, sf):
    return flat(orders_run(spark, sf, dates=True, date_formats=("%Y-%m-%d", "%d/%m/%Y")).results)


def recon_date_forms(spark, sf):
    """Dates as day of the year, with names of days and months, and with a time of day; every tenth one with a day that is not that date's."""
    n, day = F.col("n"), F.to_date("odate")
    forms = F.when(n % 4 == 0, F.date_format(day, "yyyy-DDD")).when(n % 4 == 1, F.date_format(day, "EEEE, d MMMM yyyy")).when(n % 4 == 2, F.concat(F.date_format(day, "dd-MMM-yy"), F.lit(" 07:30 PM")))
    wrong = F.when(n % 10 == 9, F.concat(F.date_format(F.date_add(day, 1), "EEEE, "), F.date_format(day, "d MMMM yyyy")))
    b = orders_a(spark, sf).withColumn("odate", F.coalesce(wrong, forms, "odate"))
    rules = Normalization(dates=True, date_formats=("%F", "%Y-%j", "%A, %e %B %Y", "%d-%b-%y %I:%M %p"))
    spec = replace(SPEC, values_a=("odate",), values_b=("odate",), normalization=rules)
    return flat(reconcile(orders_a(spark, sf), b, spec).results)


def recon_numeric(spark, sf):
    b = orders_b(spark, sf).withColumn("price", F.concat(F.lit("+00"), "price", F.lit("00")))
    return flat(reconcile(orders_a(spark, sf), b, replace(SPEC, normalization=Normalization(numbers=True))).results)


def recon_decimal_trim(spark, sf):
    return flat(orders_run(spark, sf, decimals=1).results)


def recon_differences(spark, sf):
    return views.difference_rows(orders_run(spark, sf).results).withColumn("key", F.array_join("key", "|"))


def recon_paired_values(spark, sf):
    return views.paired_values(orders_run(spark, sf).results, SPEC).withColumn("key", F.array_join("key", "|"))


def recon_unkeyed(spark, sf):
    return flat(views.filter_results(orders_run(spark, sf).results, "unkeyed_left"))


def recon_multi_key(spark, sf):
    spec = replace(SPEC, keys_a=("k", "status"), keys_b=("k", "status"), values_a=("price",), values_b=("price",))
    found = reconcile(orders_a(spark, sf), orders_b(spark, sf), spec).results
    return found.groupBy("result_type").agg(F.count("*").alias("n"), F.min(F.array_join("key", "|")).alias("first_key"))


def search_results(spark, sf):
    return flat(views.search_results(orders_run(spark, sf).results, " 77 ", "key"))


def sort_results(spark, sf):
    return flat(views.page(orders_run(spark, sf).results, 200, 0, "key"))


def export_table(spark, sf):
    return export_rows(orders_run(spark, sf).results, SPEC).drop("_order")


def recon_duplicates(spark, sf):
    cells = ["l_partkey", "l_suppkey"]
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        *(F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_linenumber", *cells)),
        F.col("l_quantity").cast("decimal(18,2)").alias("q"),
        F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("n"),
    )
    keys = ("l_orderkey", "l_linenumber")
    spec = ReconSpec(keys, keys, tuple(cells), tuple(cells), order_a=("n",), order_b=("n",), json_equality=False)
    found = views.filter_results(reconcile(lines, lines.where("q <= 25"), spec).results, "duplicate")
    return found.select("result_type", F.array_join("key", "|").alias("key"), duplicate_text().alias("rows"), duplicate_json("a").alias("rows_a"))


def events_sides(spark, sf):
    a = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("n"), F.col("event_id").cast("string").alias("id"), "props")
    swapped = F.concat(F.lit('{"z": 1, "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    changed = F.when(F.col("n") % 7 == 0, F.lit('{"k": -1}')).when(F.col("n") % 3 == 0, swapped).otherwise(F.col("props"))
    return a.withColumn("both", F.when(F.col("n") % 3 == 0, F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"z":1}'))).otherwise(F.col("props"))), a.withColumn("props", changed)


def recon_json_field(spark, sf):
    a, b = events_sides(spark, sf)
    spec = ReconSpec(("id",), ("id",), ("props.k",), ("props.k",), order_a=("n",), order_b=("n",))
    return flat(reconcile(a, b, spec).results)


def recon_json_equal(spark, sf):
    a, b = events_sides(spark, sf)
    spec = ReconSpec(("id",), ("id",), ("both",), ("props",), order_a=("n",), order_b=("n",))
    return reconcile(a, b, spec).results.select("result_type", F.array_join("key", "|").alias("key"))


def json_paths(spark, sf):
    return discover(events_sides(spark, sf)[1].select("id", "props"))


def column_types(spark, sf):
    return infer_types(orders_a(spark, sf).drop("n"))


def column_profile(spark, sf):
    return profile(values_of(orders_a(spark, sf), ["k", "status", "price", "odate"])).withColumn("unique_ratio", F.round("unique_ratio", 6))


def column_overlap(spark, sf):
    return overlap(values_of(orders_a(spark, sf), ["k", "status", "price", "odate"]), values_of(orders_b(spark, sf), ["k", "status", "price", "odate"]))


def pair_suggestions(spark, sf):
    renamed = orders_b(spark, sf).select(F.col("k").alias("ref"), F.col("status").alias("order_state"), F.col("price").alias("amount"), F.col("prio").alias("Priority"))
    found = suggest_pairs(orders_a(spark, sf).select("k", "status", "price", "prio"), renamed)
    return spark.createDataFrame([(p.a, p.b, p.kind, round(p.similarity, 6)) for p in found], "file_a_column string, file_b_column string, mapping_type string, similarity double")


def flexible_sides(spark, sf, key_a, key_b):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("t"), "o_orderstatus")
    return orders.withColumn("k", key_a), orders.where("n % 17 != 0").withColumn("k", key_b)


def flex_spec(**more):
    return ReconSpec(("k",), ("k",), ("o_orderstatus",), ("o_orderstatus",), flexible=True, order_a=("n",), order_b=("n",), json_equality=False, **more)


def flex_wildcard(spark, sf):
    sides = flexible_sides(spark, sf, F.when(F.col("n") % 50 == 0, F.concat("t", F.lit("-**"))).otherwise(F.concat("t", F.lit("-X"))), F.concat("t", F.lit("-X")))
    return reconcile(*sides, flex_spec()).results.select("result_type", F.array_join("key", "|").alias("key"))


def flex_tokens(spark, sf):
    name = F.concat(F.lit("ORDER-"), "t", F.lit(" ACME"), "t")
    sides = flexible_sides(spark, sf, F.concat(name, F.lit(" INV")), F.concat(name, F.lit(" PAID")))
    return reconcile(*sides, flex_spec()).results.select("result_type", F.array_join("key", "|").alias("key"))


# Side A has three patterns for every part, each of which fits fewer keys than the one before, and side B a key for each, but for some that are lost.
PATTERNS, FITTING = ("-**", "-A**", "-AB**"), ("-ABC", "-AX", "-Y")


def flex_assignment(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("o_orderstatus"))

    def side(ends: tuple[str, ...]) -> DataFrame:
        each = parts.select("part", "o_orderstatus", F.posexplode(F.array(*map(F.lit, ends))).alias("j", "end"))
        return each.withColumn("n", 3 * F.col("part") + F.col("j")).withColumn("k", F.concat(F.lpad(F.col("part").cast("string"), 15, "0"), "end"))

    return reconcile(side(PATTERNS), side(FITTING).where("(part + j) % 5 != 0"), flex_spec()).results.select("result_type", F.array_join("key", "|").alias("key"))


def recon_order(spark, sf):
    """Where each result stands: phase, then the first row of the leading side."""
    found = orders_run(spark, sf).results
    return found.select("result_type", F.array_join("key", "|").alias("key"), "_order.phase", F.col("_order.first_a.n").alias("first_a"), F.col("_order.first_b.n").alias("first_b"))


def recon_blanks(spark, sf):
    """Cells with white space around them, of white space alone, and empty ones."""
    n, status = F.col("n"), F.col("status")
    spaced = F.when(n % 7 == 0, "").when(n % 7 == 1, " \t ").when(n % 7 == 2, F.concat(F.lit(" \t"), status, F.lit("\n "))).otherwise(status)
    keyed = F.when(n % 13 == 0, "").when(n % 13 == 1, "  ").when(n % 13 == 2, F.concat(F.lit(" "), "k", F.lit("\t"))).otherwise(F.col("k"))
    a = orders_a(spark, sf).withColumn("k", keyed).withColumn("status", F.when(n % 5 == 0, "").otherwise(status))
    b = orders_a(spark, sf).withColumn("status", spaced)
    spec = replace(SPEC, values_a=("status",), values_b=("status",), normalization=Normalization(trim=True))
    found = reconcile(a, b, spec).results
    return found.select("result_type", F.array_join("key", "|").alias("key"), F.array_join("values_a", "|").alias("values_a"), F.array_join("values_b", "|").alias("values_b"))


def flex_pairs(spark, sf):
    """Which key is matched with which, keys of both sides left over, and where each result stands."""
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("part"))

    def side(ends: tuple[str, ...]) -> DataFrame:
        each = parts.select("part", F.posexplode(F.array(*map(F.lit, ends))).alias("j", "end"))
        return each.withColumn("n", 4 * F.col("part") + F.col("j")).withColumn("k", F.concat(F.lpad(F.col("part").cast("string"), 15, "0"), "end"))

    b = side((*FITTING, "-ZZ")).where("(part + j) % 5 != 0 and (j < 3 or part % 7 = 0)")
    spec = replace(flex_spec(), values_a=("k",), values_b=("k",))
    found = reconcile(side(PATTERNS), b, spec).results
    join = lambda c: F.array_join(c, "|").alias(c)
    return found.select("result_type", join("key"), join("values_a"), join("values_b"), "_order.phase", F.col("_order.first_a.n").alias("first_a"), F.col("_order.first_b.n").alias("first_b"))


def flex_boundaries(spark, sf):
    """Keys of two components: patterns that take the end of a component, patterns that meet patterns, and such as meet nothing."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("n"), F.concat(F.lit("P"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("t"))

    def side(*ends: tuple[str, str]) -> DataFrame:
        one, two = (F.when(F.col("n") % 3 == 0, ends[0][i]).when(F.col("n") % 3 == 1, ends[1][i]).otherwise(ends[2][i]) for i in (0, 1))
        return orders.select("n", F.concat("t", one).alias("k"), two.alias("l"))

    a, b = side(("**", "CODE"), ("-**-A", "x"), ("-**", "x")), side(("7", "TAILCODE"), ("-B-**", "x"), ("-1", "y"))
    spec = replace(flex_spec(), keys_a=("k", "l"), keys_b=("k", "l"), values_a=("l",), values_b=("l",))
    return reconcile(a, b, spec).results.select("result_type", F.array_join("key", "|").alias("key"), F.array_join("values_b", "|").alias("values_b"))


def flex_lone_words(spark, sf):
    """Keys that share one word: matched where neither has another candidate."""
    word = F.concat(F.lit("w"), F.translate(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), "0123456789", "abcdefghij"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("n"), word.alias("w"), "o_orderstatus")
    a = orders.withColumn("k", F.concat("w", F.lit(" left")))
    ends = F.when(F.col("n") % 5 == 0, F.array(F.lit(" right"), F.lit(" other"))).otherwise(F.array(F.lit(" right")))
    b = orders.where("n % 17 != 0").withColumn("end", F.explode(ends)).withColumn("k", F.concat("w", "end"))
    return reconcile(a, b, flex_spec()).results.select("result_type", F.array_join("key", "|").alias("key"))


def search_everything(spark, sf):
    """A search in all that a row shows."""
    return flat(views.search_results(orders_run(spark, sf).results, "1.5", "all"))


def saved_orders(spark, sf, searchable=False):
    """A run saved in the shared folder, in eight ranges."""
    if spark.sparkContext.getCheckpointDir() is None:
        set_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"
    save_run(orders_run(spark, sf), folder, ranges=8, searchable=searchable)
    return folder


def saved_page(spark, sf):
    """A page of the mismatches of a saved run."""
    return flat(page_saved(spark, saved_orders(spark, sf), 200, 500, "mismatch"))


def saved_search(spark, sf):
    """A search in all that a saved run shows, by its index."""
    return flat(search_saved(spark, saved_orders(spark, sf, searchable=True), "1.5"))


QUERIES = {
    f.__name__: f
    for f in (
        recon_exact_default, recon_summary, recon_facets, recon_overview, recon_case_trim, recon_dates, recon_date_forms, recon_numeric, recon_decimal_trim, recon_differences,
        recon_paired_values, recon_unkeyed, recon_multi_key, search_results, sort_results, export_table, recon_duplicates, recon_json_field, recon_json_equal,
        json_paths, column_types, column_profile, column_overlap, pair_suggestions, flex_wildcard, flex_tokens, flex_assignment,
        recon_order, recon_blanks, flex_pairs, flex_boundaries, flex_lone_words, search_everything, saved_page, saved_search,
    )
}

_R = "select result_type, key, values_a, values_b, differences from r"
_TRIM1 = "regexp_replace(cast(cast(round(cast({}.price as decimal(18,2)), 1) as decimal(18,1)) as varchar), '\\.0$', '')"
_COUNTS = """s as (
  select (select count(*) from a) as total_rows_a, (select count(*) from b) as total_rows_b,
    count(*) filter (result_type = 'match') as matches, count(*) filter (result_type = 'mismatch') as mismatches,
    count(*) filter (result_type = 'missing_left') as missing_left, count(*) filter (result_type = 'missing_right') as missing_right,
    count(*) filter (result_type = 'unkeyed_left') as unkeyed_left, count(*) filter (result_type = 'unkeyed_right') as unkeyed_right,
    count(*) filter (result_type in ('duplicate_file_a', 'duplicate_both')) as duplicates_a,
    count(*) filter (result_type in ('duplicate_file_b', 'duplicate_both')) as duplicates_b
  from r)"""
_SHARE = "cast(cast(floor(100.0 * {0} / (matches + mismatches + missing_left + missing_right) + 0.5) as bigint) as varchar) || '% of comparable rows' as {0}_share"
_DUPE = """
l as (select cast(l_orderkey as varchar) || '|' || cast(l_linenumber as varchar) as key, cast(l_partkey as varchar) as p, cast(l_suppkey as varchar) as s,
  l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate from lineitem),
ga as (select key, count(*) as c,
  '[' || string_agg(p || ', ' || s, '] | [' order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) || ']' as t,
  '[[' || string_agg('"' || p || '","' || s || '"', '],[' order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) || ']]' as j from l group by key),
gb as (select key, count(*) as c,
  '[' || string_agg(p || ', ' || s, '] | [' order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) || ']' as t from l where l_quantity <= 25 group by key)
"""
_VALUES = """va as (select 'k' as col, lower(k) as v from a union all select 'status', lower(status) from a union all select 'price', price from a union all select 'odate', odate from a),
vb as (select 'k' as col, lower(k) as v from b union all select 'status', lower(status) from b union all select 'price', price from b union all select 'odate', odate from b)"""
_EVENTS = """ea as (select event_id as n, cast(event_id as varchar) as id, json_extract_string(props, '$.k') as k from events)"""

ORACLE_SQL = {
    "recon_exact_default": f"with {resolved_sql()} {_R}",
    "recon_summary": f"with {resolved_sql()}, {_COUNTS} select * from s",
    "recon_facets": f"""with {resolved_sql()}, t as (select case when result_type like 'duplicate%' then 'duplicate' else result_type end as b from r),
        names as (select unnest(['all', 'match', 'mismatch', 'missing_left', 'missing_right', 'unkeyed_left', 'unkeyed_right', 'duplicate']) as bucket)
        select bucket, (select count(*) from t where t.b = names.bucket or names.bucket = 'all') as n from names""",
    "recon_overview": f"""with {resolved_sql()}, {_COUNTS} select matches + mismatches + missing_left + missing_right as comparable_total,
        cast(floor(100.0 * matches / (matches + mismatches + missing_left + missing_right) + 0.5) as bigint) as match_percent,
        {", ".join(_SHARE.format(c) for c in ("matches", "mismatches", "missing_left", "missing_right"))},
        cast(unkeyed_right as varchar) || ' in File A, ' || cast(unkeyed_left as varchar) || ' in File B' as ignored_notice,
        'Duplicates found: ' || cast(duplicates_a as varchar) || ' in File A, ' || cast(duplicates_b as varchar) || ' in File B' as duplicate_notice from s""",
    "recon_case_trim": f"with {resolved_sql(status='lower({}.status)')} {_R}",
    "recon_dates": f"""with {resolved_sql(odate="(case when {0}.odate like '%/%' then substr({0}.odate, 7, 4) || '-' || substr({0}.odate, 4, 2) || '-' || substr({0}.odate, 1, 2) else {0}.odate end)")} {_R}""",
    "recon_date_forms": """with t as (select o_orderkey as n, cast(o_orderkey as varchar) as k, cast(o_orderdate as date) as d from orders),
        f as (select n, k, strftime(d, '%Y-%m-%d') as va, case when n % 10 = 9 then dayname(d + 1) || strftime(d, ', %-d %B %Y') when n % 4 = 0 then strftime(d, '%Y-%j')
          when n % 4 = 1 then strftime(d, '%A, %-d %B %Y') when n % 4 = 2 then strftime(d, '%d-%b-%y 07:30 PM') else strftime(d, '%Y-%m-%d') end as vb from t)
        select case when n % 10 = 9 then 'mismatch' else 'match' end as result_type, k as key, va as values_a, vb as values_b,
        case when n % 10 = 9 then 'odate: ' || va || ' -> ' || vb else '' end as differences from f""",
    "recon_numeric": f"""with {resolved_sql(AB.replace("b as (", "b1 as (") + ", b as (select n, k, status, '+00' || price || '00' as price, odate, prio from b1)", price="cast({}.price as decimal(18,4))")} {_R}""",
    "recon_decimal_trim": f"with {resolved_sql(price=_TRIM1, shown=_TRIM1)} {_R}",
    "recon_differences": f"""with {resolved_sql()}, p as (select r.*, x.status as s1, x.price as p1, x.odate as d1, y.status as s2, y.price as p2, y.odate as d2
        from r join a x on x.k = r.key join b y on y.k = r.key where result_type = 'mismatch')
        select result_type, key, 'status' as column_a, 'status' as column_b, s1 as value_a, s2 as value_b from p where s1 <> s2
        union all select result_type, key, 'price', 'price', p1, p2 from p where p1 <> p2
        union all select result_type, key, 'odate', 'odate', d1, d2 from p where d1 <> d2""",
    "recon_paired_values": f"""with {resolved_sql()}, p as (
        select result_type, key, 0 as row_no, case when values_a <> '' then string_split(values_a, '|') end as va, case when values_b <> '' then string_split(values_b, '|') end as vb
        from r where result_type not like 'duplicate%'
        union all select 'duplicate_file_b', k, cast(row_number() over (partition by k order by n) - 1 as integer), null, [status, price, odate]
        from b where k in (select key from r where result_type = 'duplicate_file_b'))
        select result_type, key, row_no, c as column_a, c as column_b, va[i] as value_a, vb[i] as value_b
        from p, (select 1 as i, 'status' as c union all select 2, 'price' union all select 3, 'odate') q""",
    "recon_unkeyed": f"with {resolved_sql()} {_R} where result_type = 'unkeyed_left'",
    "recon_multi_key": f"""with {AB}, ga as (select k || '|' || status as key, min(price) as p from a group by 1),
        gb as (select k || '|' || status as key, count(*) as c, min(price) as p from b where k <> 'N/A' group by 1),
        t as (select case when gb.c > 1 then 'duplicate_file_b' when ga.key is null then 'missing_left' when gb.key is null then 'missing_right'
          when ga.p <> gb.p then 'mismatch' else 'match' end as result_type, coalesce(ga.key, gb.key) as key from ga full join gb on ga.key = gb.key
          union all select 'unkeyed_left', k || '|' || status from b where k = 'N/A')
        select result_type, count(*) as n, min(key) as first_key from t group by 1""",
    "search_results": f"with {resolved_sql()} {_R} where contains(lower(key), '77')",
    "sort_results": f"with {resolved_sql()} {_R} order by try_cast(key as bigint) nulls last limit 200",
    "export_table": f"""with {resolved_sql()}, t as (select r.*, case when values_a <> '' then string_split(values_a, '|') else ['', '', ''] end as va,
          case when values_b <> '' then string_split(values_b, '|') else ['', '', ''] end as vb from r),
        g as (select k, '[' || string_agg(status || ', ' || price || ', ' || odate, '] | [' order by n) || ']' as txt,
          '[[' || string_agg('"' || status || '","' || price || '","' || odate || '"', '],[' order by n) || ']]' as js from b group by k)
        select case result_type when 'match' then 'Match' when 'mismatch' then 'Mismatch' when 'missing_left' then 'Only in File B' when 'missing_right' then 'Only in File A'
            when 'unkeyed_left' then 'Ignored in File B' when 'duplicate_file_b' then 'Duplicate (File B)' end as c0,
          key as c1, va[1] as c2, va[2] as c3, va[3] as c4, vb[1] as c5, vb[2] as c6, vb[3] as c7, differences as c8, '' as c9,
          case when result_type = 'duplicate_file_b' then g.js else '' end as c10, case when result_type = 'duplicate_file_b' then 'File B: ' || g.txt else '' end as c11
        from t left join g on g.k = t.key and t.result_type = 'duplicate_file_b'""",
    "recon_duplicates": f"""with {_DUPE} select case when ga.c > 1 and gb.c > 1 then 'duplicate_both' else 'duplicate_file_a' end as result_type, ga.key,
        'File A: ' || ga.t || case when gb.c > 1 then ' ; File B: ' || gb.t else '' end as rows, ga.j as rows_a from ga left join gb on ga.key = gb.key where ga.c > 1""",
    "recon_json_field": f"""with {_EVENTS}, e as (select *, case when n % 7 = 0 then '-1' else k end as kb from ea)
        select case when k = kb then 'match' else 'mismatch' end as result_type, id as key, k as values_a, kb as values_b,
        case when k = kb then '' else 'props.k: ' || k || ' -> ' || kb end as differences from e""",
    "recon_json_equal": f"""with {_EVENTS} select case when n % 7 = 0 and not (n % 3 <> 0 and k = '-1') then 'mismatch' else 'match' end as result_type, id as key from ea""",
    "json_paths": "select 'props.k' as label union all select 'props.z'",
    "column_types": """select * from (values (0, 'k', 'integer'), (1, 'status', 'string'), (2, 'price', 'float'), (3, 'odate', 'date'), (4, 'prio', 'string')) t("index", name, data_type)""",
    "column_profile": f"""with {AB}, {_VALUES} select col, count(distinct v) as unique_values, count(*) as non_empty, round(count(distinct v) / cast(count(*) as double), 6) as unique_ratio,
        case col when 'k' then 'integer' when 'price' then 'decimal' else 'text' end as kind from va group by col""",
    "column_overlap": f"""with {AB}, {_VALUES}, da as (select distinct * from va), db as (select distinct * from vb)
        select da.col as col_a, db.col as col_b, count(*) as shared from da join db on da.v = db.v group by 1, 2""",
    "flex_wildcard": """select 'match' as result_type, cast(o_orderkey as varchar) || case when o_orderkey % 50 = 0 then '-**' else '-X' end as key from orders where o_orderkey % 17 <> 0
        union all select 'missing_right', cast(o_orderkey as varchar) || case when o_orderkey % 50 = 0 then '-**' else '-X' end from orders where o_orderkey % 17 = 0""",
    "flex_tokens": """select case when o_orderkey % 17 <> 0 then 'match' else 'missing_right' end as result_type,
        'ORDER-' || cast(o_orderkey as varchar) || ' ACME' || cast(o_orderkey as varchar) || ' INV' as key from orders""",
    "flex_assignment": """select case when (p_partkey % 5 = 3 and j = 0) or (p_partkey % 5 = 4 and j = 1) or (p_partkey % 5 = 0 and j = 2) then 'missing_right' else 'match' end as result_type,
        lpad(cast(p_partkey as varchar), 15, '0') || ends as key from part, (values (0, '-**'), (1, '-A**'), (2, '-AB**')) t(j, ends)""",
    "recon_order": f"""with {resolved_sql()} select result_type, key, case when result_type = 'unkeyed_left' then 1 when result_type = 'missing_left' or ca = 0 then 3 else 2 end as phase,
        case when ca > 0 then fa end as first_a, case when ca = 0 then fb end as first_b from r join m on m.k = r.key where result_type <> 'unkeyed_left'
        union all select 'unkeyed_left', y.k, 1, null, y.n from b y where lower(y.k) in ('', 'null', 'na', 'n/a', 'none')""",
    "recon_blanks": """with t as (select o_orderkey as n, cast(o_orderkey as varchar) as k, o_orderstatus as s from orders),
        c as (select n, k, case n % 13 when 0 then '' when 1 then '  ' when 2 then ' ' || k || chr(9) else k end as ka, case when n % 5 = 0 then '' else s end as va,
          case n % 7 when 0 then '' when 1 then ' ' || chr(9) || ' ' when 2 then ' ' || chr(9) || s || chr(10) || ' ' else s end as vb,
          case when n % 5 = 0 then null else s end as na, case when n % 7 in (0, 1) then null else s end as nb from t)
        select case when na is not distinct from nb then 'match' else 'mismatch' end as result_type, ka as key, va as values_a, vb as values_b from c where n % 13 > 1
        union all select 'missing_left', k, '', vb from c where n % 13 <= 1
        union all select 'unkeyed_right', ka, va, '' from c where n % 13 <= 1""",
    "flex_pairs": """with p as (select p_partkey as part, lpad(cast(p_partkey as varchar), 15, '0') as t from part),
        a as (select part, 4 * part + j as n, t || e as k, j from p, (values (0, '-**'), (1, '-A**'), (2, '-AB**')) x(j, e)),
        b as (select part, 4 * part + j as n, t || e as k, j from p, (values (0, '-ABC'), (1, '-AX'), (2, '-Y'), (3, '-ZZ')) x(j, e) where (part + j) % 5 <> 0 and (j < 3 or part % 7 = 0)),
        w as (select a.part, a.j, case when a.j = 0 and not exists (select 1 from b where b.part = a.part and b.j = 2) then 3 else 2 - a.j end as jb from a),
        met as (select a.n as na, b.n as nb, a.k as ka, b.k as kb from a join w on w.part = a.part and w.j = a.j join b on b.part = w.part and b.j = w.jb)
        select 'mismatch' as result_type, ka as key, ka as values_a, kb as values_b, 2 as phase, na as first_a, nb as first_b from met
        union all select 'missing_right', k, k, '', 3, n, null from a where n not in (select na from met)
        union all select 'missing_left', k, '', k, 4, null, n from b where n not in (select nb from met)""",
    "flex_boundaries": """with t as (select o_orderkey % 3 as m, 'P' || lpad(cast(o_orderkey as varchar), 12, '0') as t from orders)
        select 'mismatch' as result_type, t || '**|CODE' as key, 'TAILCODE' as values_b from t where m = 0
        union all select 'match', t || '-**-A|x', 'x' from t where m = 1
        union all select 'missing_right', t || '-**|x', '' from t where m = 2
        union all select 'missing_left', t || '-1|y', 'y' from t where m = 2""",
    "flex_lone_words": """with t as (select o_orderkey as n, 'w' || translate(lpad(cast(o_orderkey as varchar), 12, '0'), '0123456789', 'abcdefghij') as w from orders)
        select case when n % 17 <> 0 and n % 5 <> 0 then 'match' else 'missing_right' end as result_type, w || ' left' as key from t
        union all select 'missing_left', w || e from t, (values (' right'), (' other')) x(e) where n % 17 <> 0 and n % 5 = 0""",
    "saved_page": f"with {resolved_sql()} select result_type, key, values_a, values_b, differences from r join m on m.k = r.key where result_type = 'mismatch' order by fa limit 200 offset 500",
    "search_everything": f"""with {resolved_sql()}, dup as (select k, string_agg(status || ' ' || price || ' ' || odate, ' ' order by n) as txt from b group by k)
        select result_type, key, values_a, values_b, differences from r left join dup on dup.k = r.key and r.result_type = 'duplicate_file_b'
        where contains(concat_ws(' ', key, replace(values_a, '|', ' '), replace(values_b, '|', ' '), txt, differences), '1.5')""",
}
ORACLE_SQL["saved_search"] = ORACLE_SQL["search_everything"]
