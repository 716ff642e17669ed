"""URL rules with redirect equivalence.

A rule decides the URLs it fits.  URLs that redirect to one another or name one
another as canonical are one resource: the components of those links share
decisions, so a block reaches every alias that no rule decides itself, unless
an explicit allow is among the aliases, which takes precedence.

DataFrame functions only.  Defined results: a null URL, or one without
``://``, has empty host and path, fits no rule and takes part in no link; a
repeated row is judged like its first copy; of rules of one length that fit,
an allow wins; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host, path, verdict
Rule = tuple[str, str, str]
#: Up to so many rules are compiled into the plan; more are joined as a table.
INLINE_RULES = 256


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _best_inline(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    ranked = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), r[2], r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in reversed(ranked):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def _best_joined(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``places`` (host, path; distinct) with ``best``; the rules are a table of any size."""
    r = rules.select(
        F.col("host").alias("r_host"),
        F.concat("host", "path").alias("rule"),
        F.col("path").alias("r_path"),
        "verdict",
    ).distinct()
    cut = places.select("host", "path", F.explode(_host_suffixes(F.col("host"))).alias("r_host"))
    best = (
        cut.join(r, "r_host")
        .where(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("n"), "verdict", "rule")).alias("b"))
        .select("host", "path", F.struct("b.rule", "b.verdict").alias("best"))
    )
    return places.join(best, ["host", "path"], "left")


def url_key(url: Column) -> Column:
    """What names a resource in links: the URL without its fragment, scheme and host in lower case."""
    head = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    key = F.concat(F.translate(head, UPPER, LOWER), F.lit("://"), host_of(url), rest)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, key)


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL for ``href`` as found on the page ``base``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return _without_dots(
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when((F.length(href) > 0) & ~href.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#)"), F.concat(folder, href))
    )


def _without_dots(url: Column) -> Column:
    """The URL without ``.`` and ``..`` segments in its path."""
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    parts = F.split(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), "/")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)

    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = F.element_at(parts, -1).isin(".", "..")
    path = F.array_join(F.when(folder, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(url.contains("/."), F.concat(origin, path, rest)).otherwise(url)


TAG = r"(?is)<(?:link|meta)\s[^>]*>"


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, without quotes and outer blanks; empty if there is none."""
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    return F.regexp_replace(value, r"""^["']?\s*|\s*["']?$""", "")


def links_of_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)`` keys of redirect (meta refresh) and canonical links, all that the pages hold."""
    found = pages.select(pages[url_col].alias("url"), F.explode(F.regexp_extract_all(pages[html_col], F.lit(TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    canonical = tag.rlike(r"(?i)^<link") & _attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = tag.rlike(r"(?i)^<meta") & _attribute(tag, "http-equiv").rlike(r"(?i)^refresh$")
    target = F.regexp_extract(_attribute(tag, "content"), r"""(?is)url\s*=\s*["']?([^"'\s>]+)""", 1)
    href = F.when(canonical, _attribute(tag, "href")).when(refresh, target)
    found = found.select("url", F.replace(href, F.lit("&amp;"), F.lit("&")).alias("href")).where("href <> ''")
    return (
        found.select(url_key(F.col("url")).alias("a"), url_key(resolve(F.col("url"), F.col("href"))).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    links: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, component)``, one row per row of ``pages``.

    ``rules`` is a sequence of (host, path, allow|block) or a DataFrame with
    those columns (host, path, verdict).  ``links`` (a, b: two URLs that
    redirect or are canonical for one another) adds to those found in the pages.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    edges = links_of_pages(pages, url_col, html_col)
    if links is not None:
        edges = edges.union(links.select(url_key(links["a"]), url_key(links["b"])))
    component = connected_components(edges)

    judged = pages.select(
        pages[id_col].alias("page_id"),
        host_of(pages[url_col]).alias("host"),
        path_of(pages[url_col]).alias("path"),
        url_key(pages[url_col]).alias("key"),
    )
    if isinstance(rules, DataFrame):
        # one row a place before the join: a host with very many pages counts once a path
        places = scratch.keep(judged.select("host", "path").distinct(), "places")
        judged = judged.join(scratch.keep(_best_joined(places, rules), "best"), ["host", "path"], "left")
    else:
        if len(rules) > INLINE_RULES:
            raise ValueError(f"give more than {INLINE_RULES} rules as a DataFrame")
        judged = judged.withColumn("best", _best_inline(F.col("host"), F.col("path"), rules))

    # rules also decide the URLs that only links name; nodes are one row a URL
    nodes = scratch.keep(component, "components")
    named = nodes.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    if isinstance(rules, DataFrame):
        named = named.join(_best_joined(named.select("host", "path").distinct(), rules), ["host", "path"], "left")
    else:
        named = named.withColumn("best", _best_inline(F.col("host"), F.col("path"), rules))
    # allow sorts before block, so the smallest verdict of a component is the one that holds
    shared = scratch.keep(
        named.where("best is not null").groupBy("component").agg(F.min("best.verdict").alias("shared")), "shared"
    )
    decided = scratch.keep(nodes.join(shared, "component", "left"), "decided")
    out = judged.join(decided, judged["key"] == decided["node"], "left")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", "shared", F.lit("allow")).alias("verdict"),
        F.coalesce("component", "key").alias("component"),
    )
