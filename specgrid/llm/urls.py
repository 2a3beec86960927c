"""URL decisions by rules, spread over redirects and canonical links.

Rules name a host and a path prefix. A page that no rule fits takes the decision
of the addresses that it is an alias of: redirect and canonical-link edges join
addresses into components (see ``components``), an explicit allow anywhere in a
component outweighs its blocks, a block reaches all the rest, and a component
without any rule is allowed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgrid.llm.common import Scratch
from specgrid.llm.components import connected_components

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]  # verdict, host, path

#: Tags that may link or set the base; quoted attributes may hold ``>``.
_TAG = r"""(?is)<(?:link|meta|base)\b(?:(?:[^'">]++|"[^"]*+"|'[^']*+')*+|[^>]*+)>"""
_ATTRIBUTE = r"""(?is)([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
_URL = r"(?is)^\s*[\d.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'>\s]+)"

# Character references; numbers 128 to 159 mean Windows-1252.
_NAMES = html5 | {f"#{i}": bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)}
_REFERENCE = r"&#[0-9]{1,9};?|&#[xX][0-9A-Fa-f]{1,7};?|&[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9]))|[^&]+|&"


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return _lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The same resource under one name: no fragment, scheme and host in lower case; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    scheme = _lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), rest))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct ``(rule, verdict)`` of the longest fitting rule, allow first on ties; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == ALLOW)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` in the plan once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unescape(text: Column) -> Column:
    """An attribute's text with its character references decoded; a name without ``;`` only before neither ``=`` nor a letter or digit."""
    names = F.from_json(F.lit(json.dumps(_NAMES)), "map<string,string>")

    def char(code: Column) -> Column:
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(F.when(real, code)), 8, "0")), "UTF-32")).otherwise(F.lit("�"))

    def decoded(t: Column) -> Column:
        hexed = F.conv(F.nullif(F.regexp_extract(t, r"^&#[xX]([0-9A-Fa-f]+)", 1), F.lit("")), 16, 10)
        code = F.coalesce(hexed, F.regexp_extract(t, r"^&#([0-9]+)", 1)).try_cast("long")
        key = F.when(t.startswith("&#"), F.concat(F.lit("#"), code.cast("string"))).otherwise(F.substring(t, 2, 64))
        return F.when(~t.startswith("&"), t).otherwise(F.coalesce(F.try_element_at(names, key), _let(code, lambda c: F.when(c.isNotNull(), char(c))), t))

    return _let(text, lambda x: F.when(x.contains("&"), F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f"(?s){_REFERENCE}"), F.lit(0)), decoded), "")).otherwise(x))


def _without_dots(path: Column) -> Column:
    """A path that starts with ``/``, its ``.`` and ``..`` carried out."""
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    step = lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 30), F.array().cast("array<string>"), step)
    folder = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), folder), "^//$", "/")


def resolve(to: Column, base: Column) -> Column:
    """Target of a link on the page ``base``: absolute, or relative to its scheme, root, path or query; null if there is none."""
    to = F.regexp_replace(F.regexp_replace(to, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")

    def joined(x: Column) -> Column:
        t, b = x["t"], x["b"]
        origin = F.regexp_extract(b, r"(?s)^(.*?://[^/?#]*)", 1)
        folder = F.regexp_extract(path_of(b), r"(?s)^/(.*/)?", 0)
        head, tail = F.regexp_extract(t, r"(?s)^[^?#]*", 0), F.regexp_extract(t, r"(?s)^[^?#]*(.*)$", 1)
        whole = F.when(t.startswith("/"), head).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), head))
        relative = (
            F.when(t.startswith("//"), F.concat(F.regexp_extract(b, r"(?s)^(.*?:)//", 1), t))
            .when((t == "") | t.startswith("#"), b)
            .when(t.startswith("?"), F.concat(origin, path_of(b), t))
            .otherwise(F.concat(origin, _let(whole, _without_dots), tail))
        )
        return F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t).when(b.contains("://"), relative)

    return _let(F.struct(to.alias("t"), base.alias("b")), joined)


def _attributes(tag: Column) -> Column:
    """A tag's name (``tag``) and attributes, names in lower case; of several of one name the first counts."""
    part = lambda i: F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(i))
    either = F.zip_with(F.zip_with(part(2), part(3), lambda a, b: F.concat(a, b)), part(4), lambda a, b: F.concat(a, b))
    return F.struct(F.transform(part(1), lambda n: F.lower(n)).alias("names"), either.alias("values"))


def _value(attributes: Column, name: str) -> Column:
    """Value of an attribute, null if there is none."""
    at = F.array_position(F.slice(attributes["names"], 2, 1 << 30), name)
    return F.when(at > 0, F.get(attributes["values"], at.cast("int")))


def link_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` addresses: all canonical links and meta redirects in the pages' html, resolved against the page's url or ``<base>``.

    ``rel`` is a list of words, of which one must be canonical. Pages without such
    a word are passed over by one look at their html; what stands in comments links nothing.
    """
    html = F.col("html").cast("string")
    some = pages.where(html.rlike("(?i)canonical|http-equiv")).select(F.col("url").cast("string").alias("url"), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " ").alias("html"))
    tags = F.transform(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0)), _attributes)
    some = some.select("url", tags.alias("tags"))

    def target(t: Column) -> Column:
        rel = F.split(F.lower(F.coalesce(_value(t, "rel"), F.lit(""))), r"[\t\n\f\r ]+")
        refresh = F.trim(F.lower(F.coalesce(_value(t, "http-equiv"), F.lit("")))) == "refresh"
        kind = t["names"][0]
        moved = F.nullif(F.regexp_extract(F.coalesce(_value(t, "content"), F.lit("")), _URL, 1), F.lit(""))
        return F.when((kind == "link") & F.array_contains(rel, "canonical"), F.nullif(_value(t, "href"), F.lit(""))).when((kind == "meta") & refresh, moved)

    bases = F.filter(F.transform("tags", lambda t: F.when(t["names"][0] == "base", F.nullif(_value(t, "href"), F.lit("")))), lambda x: x.isNotNull())
    links = some.select("url", F.get(bases, F.lit(0)).alias("base"), F.explode(F.array_distinct(F.filter(F.transform("tags", target), lambda x: x.isNotNull()))).alias("to"))
    base = F.coalesce(resolve(unescape(F.col("base")), F.col("url")), F.col("url"))
    links = links.withColumn("base", base).select(address(F.col("url")).alias("src"), address(resolve(unescape(F.col("to")), F.col("base"))).alias("dst"))
    return links.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def judge(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url, html)``.

    ``edges(src, dst)`` adds redirects known from elsewhere to those found in
    the html. A null url, or one without ``://``, has an empty host and path,
    fits no rule, is no alias and is allowed. Repeated rows come back each;
    extra columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    links = link_edges(pages)
    if edges is not None:
        known = edges.select(address(F.col("src").cast("string")).alias("src"), address(F.col("dst").cast("string")).alias("dst"))
        links = links.unionByName(known.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")).distinct()
    links = scratch.keep(links, "links")

    url = F.col("url").cast("string")
    seen = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("address"))
    seen = seen.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    plain = seen.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("own_verdict"), "address")
    if links.isEmpty():
        return plain.select("page_id", "host", "path", "rule", F.coalesce("own_verdict", F.lit(ALLOW)).alias("verdict"))

    # Addresses on edges get numbers (64-bit hashes), so that the rounds move longs, not strings.
    name = lambda c: F.xxhash64(c)
    numbered = links.select(name("src").alias("a"), name("dst").alias("b"))
    groups = connected_components(scratch.keep(numbered, "numbered"), scratch)
    ends = links.select(F.col("src").alias("address")).union(links.select("dst")).distinct()
    ruled = ends.withColumn("own", longest_rule(host_of(F.col("address")), path_of(F.col("address")), rules))
    votes = ruled.join(groups, name("address") == F.col("node")).select("address", "component", F.col("own.verdict").alias("v"))
    votes = scratch.keep(votes, "votes")
    decided = votes.groupBy("component").agg(F.max(F.when(F.col("v") == ALLOW, 2).when(F.col("v") == BLOCK, 1)).alias("d"))
    spread = votes.join(decided, "component").select("address", "d")
    # Pages without an address are no aliases; they would all meet on one join key.
    known = plain.where("address IS NOT NULL").join(spread, "address", "left").select(*plain.columns, "d")
    out = known.unionByName(plain.where("address IS NULL").withColumn("d", F.lit(None).cast("int")))
    alias = F.when(F.col("d") == 1, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return out.select("page_id", "host", "path", "rule", F.coalesce("own_verdict", alias).alias("verdict"))
