"""URL filters with redirect equivalence.

A rule is a host and a path prefix with a verdict; it fits its host and all subdomains, and of those that
fit the one of the longest text wins.  Pages that name each other by a canonical link or a redirect are aliases:
distributed connected components over those edges pass a block on to every alias that no rule fits; an
explicit allow takes precedence for the page it fits.  All of it is DataFrame expressions.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed; null
html has no edges; every canonical link (one word of ``rel``) and every refresh of a page counts; an edge's target need not be a page of the table (it is judged by the rules all the same); the
scheme and the fragment do not tell urls apart; links in scripts, styles, text fields, titles and templates do not count, nor do targets without a host (mailto); relative
targets, dot segments and character references are read as a browser reads them; repeated rows give repeated results; other columns are kept, but for those of the
results' names, which the results replace; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.normalize import let
from concordat.llm.common import unused, without
from concordat.operators.graph import components


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str  # allow or block


#: The policy of the registered query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# a tag to its end, whatever its attribute values hold; possessive, so that a tag of any length takes no recursion
_REST = r"""\b(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>"""
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|noscript|xmp|iframe)\b.*?(?:</\1\b[^>]*+>|\z)"
# an attribute: name and value, so that what stands in one value is not taken for another
_ATTRIBUTE = r"""(?s)[\s/"']([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
# Named character references that urls are written with.
NAMED = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&sol;": "/", "&colon;": ":", "&quest;": "?", "&num;": "#", "&equals;": "=", "&period;": ".", "&amp;": "&"}


def tags_of(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(f"(?is)<{name}{_REST}"), F.lit(0))


def decoded(value: Column) -> Column:
    """value with its numeric character references, those of NAMED last, as letters."""
    number = F.regexp_extract_all(value, F.lit(r"&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));?"), F.lit(0))

    def letter(reference: Column) -> Column:
        by_16 = F.conv(F.regexp_extract(reference, "[xX]([0-9A-Fa-f]+)", 1), 16, 10).cast("int")
        code = F.coalesce(by_16, F.regexp_extract(reference, "^&#([0-9]+)", 1).try_cast("int"))
        sixteen = lambda n: F.lpad(F.hex(n), 4, "0")
        far = code - 0x10000
        units = F.when(code < 0x10000, sixteen(code)).otherwise(F.concat(sixteen(F.shiftright(far, 10) + 0xD800), sixteen(far.bitwiseAND(F.lit(0x3FF)) + 0xDC00)))
        fits = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        return F.when(fits, F.decode(F.unhex(units), "UTF-16BE")).otherwise(reference)

    out = F.when(F.contains(value, F.lit("&#")), F.aggregate(F.array_distinct(number), value, lambda v, r: F.replace(v, r, letter(r)))).otherwise(value)
    for name, sign in NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.when(F.contains(value, F.lit("&")), out).otherwise(value)


def attribute(tag: Column, name: str) -> Column:
    """The value of the tag's first attribute of that name, without its quotes; empty if it has none."""
    # only a tag that names it is taken apart
    tag = F.when(F.contains(F.lower(tag), F.lit(name)), tag)
    pairs = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    own = F.get(F.filter(pairs, lambda p: p.rlike(rf"""(?is)^[\s/"']{name}(?:\s*=|$)""")), F.lit(0))
    value = F.regexp_extract(own, r"""(?s)^[^=]*+=\s*+(.*+)$""", 1)
    return F.coalesce(let(F.regexp_replace(value, r"""^["']|["']$""", ""), decoded), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What a url is compared by: host, path and query."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    path = path_of(url)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def decided(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(size, allows, rule, verdict) of the rule that wins; null if none fits.

    rules is a policy of at most some hundreds of rules, held in the plan.
    """
    found = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(
                F.lit(len(r.host + r.path)).alias("size"),
                F.lit(r.verdict == "allow").alias("allows"),
                F.lit(r.host + r.path).alias("rule"),
                F.lit(r.verdict).alias("verdict"),
            ),
        )
        for r in rules
    ]
    return F.array_max(F.array(*found))


def without_dots(url: Column) -> Column:
    """url with ``.`` and ``..`` segments of its path carried out."""

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(segment == ".", done).when(segment == "..", up).otherwise(F.concat(done, F.array(segment)))

    def carried_out(url: Column) -> Column:
        site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
        path, rest = path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)
        segments = F.aggregate(F.slice(F.split(path, "/"), 2, F.length(path) + 1), F.array(F.lit("")), step)
        ends = F.when(path.rlike(r"(?s)/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
        return F.concat(site, F.array_join(segments, "/"), ends, rest)

    return let(url, lambda u: F.when(path_of(u).rlike(r"(?s)/\.\.?(?:/|$)"), carried_out(u)).otherwise(u))


def resolved(target: Column, base: Column) -> Column:
    """target as an absolute url, read on the page base; null if it is of a scheme that has no host, such as mailto."""
    return without_dots(let(F.btrim(target, F.lit(" \t\r\n\f")), lambda t: let(base, lambda b: _absolute(t, b))))


def _absolute(target: Column, base: Column) -> Column:
    scheme = F.regexp_extract(base, r"(?s)^(.*?://)", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_extract(page, r"(?s)^(.*/)", 1))
    return (
        F.when((target == "") | target.startswith("#"), base)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.rtrim(scheme, F.lit("/")), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(page, target))
        .otherwise(F.concat(folder, target))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes of a page and of what each of its canonical links and redirects names, read on the page's base; comments and scripts do not count."""
    lower = F.lower(html)
    named = pages.where(F.contains(lower, F.lit("canonical")) | F.contains(lower, F.lit("refresh")))
    read = named.select(F.col(url).alias("url"), F.regexp_replace(html, _UNREAD, "").alias("html"))
    base = F.coalesce(F.get(F.filter(F.transform(tags_of(F.col("html"), "base"), lambda t: attribute(t, "href")), lambda h: h != ""), F.lit(0)), F.lit(""))
    links = F.filter(tags_of(F.col("html"), "link"), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(tags_of(F.col("html"), "meta"), lambda t: F.lower(F.btrim(attribute(t, "http-equiv"))) == "refresh")
    # a number, a separator, and the target with or without ``url=`` and quotes
    after = lambda t: F.regexp_extract(attribute(t, "content"), r"""(?is)^[\s\d.]*[\s;,]\s*(?:url\s*=\s*)?["']?([^"'>\s]+)""", 1)
    targets = F.concat(F.transform(links, lambda t: attribute(t, "href")), F.transform(metas, after))
    found = read.select("url", resolved(base, F.col("url")).alias("base"), F.explode(targets).alias("target")).where("target != ''")
    absolute = resolved(F.col("target"), F.col("base"))
    return found.select(node_of(F.col("url")).alias("a"), node_of(absolute).alias("b")).where("b is not null")


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", html: str = "html", more_edges: DataFrame | None = None
) -> DataFrame:
    """Adds host, path, rule, verdict and inherited (a block that an alias passed on).

    more_edges: (a, b) urls, such as a log of redirects.
    """
    edges = alias_edges(pages, url, html)
    if more_edges is not None:
        edges = edges.union(more_edges.select(node_of(F.col("a")), node_of(F.col("b"))))
    aliases = components(edges)
    full = F.concat(F.lit("x://"), F.col("node"))
    marked = aliases.withColumn("blocks", F.coalesce(decided(host_of(full), path_of(full), rules)["verdict"] == "block", F.lit(False)))
    bad = marked.groupBy("component").agg(F.max("blocks").alias("bad")).where("bad")
    kept = without(pages, "host", "path", "rule", "verdict", "inherited")
    at, node, is_bad, own = (unused(pages, n) for n in ("at", "node", "bad", "own"))
    blocked = marked.join(bad, "component", "left_semi").select(F.col("node").alias(node), F.lit(True).alias(is_bad))
    judged = pages.select(
        *kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias(at)
    ).withColumn(own, decided(F.col("host"), F.col("path"), rules))
    passed = F.col(is_bad).isNotNull() & F.col(own).isNull()
    return judged.join(blocked, F.col(at) == F.col(node), "left").select(
        *kept,
        "host",
        "path",
        F.col(f"{own}.rule").alias("rule"),
        F.coalesce(F.col(f"{own}.verdict"), F.when(passed, "block").otherwise("allow")).alias("verdict"),
        passed.alias("inherited"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "inherited")


OP3_SQL = """
with recursive
p as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
    coalesce(regexp_extract(url, '^.*?://[^?#]*(\\?[^#]*)', 1, 's'), '') as query,
    regexp_replace(html, '<!--.*?(?:-->|$)|<script\\b.*?(?:</script\\b[^>]*>|$)', '', 'gsi') as html
  from pages
),
ruled as (
  select *, case when url like '%://%' then host || case when path = '' then '/' else path end || query end as node,
    case
      when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
      when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
      when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/'
    end as rule
  from p
),
tags as (
  select node, url, html, 'link' as kind, unnest(regexp_extract_all(html, '<link\\b(?:"[^"]*"|''[^'']*''|[^''">])*>', 0, 'si')) as tag from ruled
  union all
  select node, url, html, 'meta', unnest(regexp_extract_all(html, '<meta\\b(?:"[^"]*"|''[^'']*''|[^''">])*>', 0, 'si')) from ruled
),
valued as (
  select node, url, kind,
    trim(regexp_extract(regexp_extract(tag, '[\\s"''/]rel\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1, 'si'), '^["'']?(.*?)["'']?$', 1, 's')) as rel,
    trim(regexp_extract(regexp_extract(tag, '[\\s"''/]href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1, 'si'), '^["'']?(.*?)["'']?$', 1, 's')) as href,
    trim(regexp_extract(regexp_extract(tag, '[\\s"''/]http-equiv\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1, 'si'), '^["'']?(.*?)["'']?$', 1, 's')) as equiv,
    regexp_extract(regexp_extract(regexp_extract(tag, '[\\s"''/]content\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1, 'si'), '^["'']?(.*?)["'']?$', 1, 's'),
      '\\burl\\s*=\\s*["'']?([^"''>\\s]+)', 1, 'si') as after,
    trim(regexp_extract(regexp_extract(regexp_extract(html, '<base\\b(?:"[^"]*"|''[^'']*''|[^''">])*>', 0, 'si'),
      '[\\s"''/]href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1, 'si'), '^["'']?(.*?)["'']?$', 1, 's')) as based
  from tags
),
named as (
  select node, case when based like '%://%' then based else url end as base, replace(case kind when 'link' then href else after end, '&amp;', '&') as target
  from valued where kind = 'link' and list_contains(regexp_split_to_array(lower(rel), '\\s+'), 'canonical') or kind = 'meta' and lower(equiv) = 'refresh'
),
absolute as (
  select node, case
      when target like '%://%' then target
      when starts_with(target, '//') then regexp_extract(base, '^(.*?:)//', 1, 's') || target
      when starts_with(target, '#') then base
      when starts_with(target, '/') then regexp_extract(base, '^(.*?://[^/?#]*)', 1, 's') || target
      when starts_with(target, '?') then regexp_extract(base, '^([^?#]*)', 1, 's') || target
      when regexp_extract(base, '^([^?#]*)', 1, 's') = regexp_extract(base, '^(.*?://[^/?#]*)', 1, 's') then regexp_extract(base, '^([^?#]*)', 1, 's') || '/' || target
      else regexp_extract(regexp_extract(base, '^([^?#]*)', 1, 's'), '^(.*/)', 1, 's') || target
    end as target
  from named where target != ''
),
parted as (
  select node, translate(regexp_extract(target, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(target, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path, regexp_extract(target, '^.*?://[^?#]*(\\?[^#]*)', 1, 's') as query
  from absolute where target like '%://%'
),
edges as (
  select distinct node as a, host || case when path = '' then '/' else path end || query as b from parted
  where node != host || case when path = '' then '/' else path end || query
),
both_ways as (select a, b from edges union select b, a from edges),
nodes as (
  select distinct a as node, regexp_extract(a, '^([^/?]*)', 1) as host, regexp_extract(a, '^[^/?]*([^?]*)', 1, 's') as path from both_ways
),
bad(node) as (
  select node from nodes where
    (host = 'example.org' or host like '%.example.org') and (starts_with(path, '/en/1') or starts_with(path, '/es/'))
    or (host = 'com' or host like '%.com') and starts_with(path, '/de/')
  union
  select e.b from bad join both_ways e on e.a = bad.node
)
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when coalesce(node in (select node from bad), false) then 'block' else 'allow' end as verdict,
  rule is null and coalesce(node in (select node from bad), false) as inherited
from ruled
"""
