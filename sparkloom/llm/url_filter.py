"""URL filters with redirect equivalence [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .scratch import materialize, temporary

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that never change what a page holds.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_form(url: Column) -> Column:
    """https, lower-case host, no fragment, no tracking parameters, no final slash or .html."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(query, rf"(^|&){TRACKING}=[^&]*", "")
    kept = F.regexp_replace(kept, r"^&", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/)$", "")
    return F.concat(F.lit("https://"), host_of(url), path, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))


def _without_dots(path: Column) -> Column:
    """Path segments ``.`` and ``..`` resolved; the path keeps its final slash."""
    steps = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.array_append(done, x)),
    )
    ends = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise("")
    return F.concat(F.array_join(steps, "/"), ends)


def resolved(url: Column, href: Column) -> Column:
    """A link's target seen from its page: absolute, or relative to the scheme, host, folder or page; null for other schemes and anchors."""
    target = F.regexp_replace(F.replace(F.trim(href), F.lit("&amp;"), F.lit("&")), r"(?s)#.*$", "")
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(url, r"(?s)^([^?#]*)", 1)
    folder = F.regexp_extract(F.concat(path_of(url), F.lit("")), r"(?s)^(.*/)", 1)
    tail = F.regexp_extract(target, r"(?s)(\?.*)$", 1)
    own = F.regexp_replace(target, r"(?s)\?.*$", "")
    return (
        F.when(F.coalesce(target, F.lit("")) == "", None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("?"), F.concat(page, target))
        .when(target.startswith("/"), F.concat(site, _without_dots(own), tail))
        .otherwise(F.concat(site, _without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own)), tail))
    )


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in double, single or no quotes."""
    pattern = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = [F.nullif(F.regexp_extract(tag, pattern, k), F.lit("")) for k in (1, 2, 3)]
    return F.coalesce(*found, F.lit(""))


def declared_links(url: Column, html: Column) -> list[Column]:
    """Targets of the first link rel=canonical and of the first meta refresh in the page."""
    link = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?\s*canonical\b)[^>]*>""", 0)
    meta = F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*>""", 0)
    refresh = F.regexp_extract(_attribute(meta, "content"), r"""(?is)\burl\s*=\s*["']?([^"']*)""", 1)
    return [resolved(url, _attribute(link, "href")), resolved(url, refresh)]


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest (action, rule) that fits, as a struct; allow wins over block for one string.

    Rules are a parameter, hence literals in the plan and no join.
    """
    ordered = sorted(set(rules), key=lambda r: (-len(r[1]), r[1], r[0] != "allow"))
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in reversed(ordered):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, component), one row for each page.

    Urls are nodes.  Edges come from ``redirects(src, dst)``, from canonical and
    refresh links in the page, and from each url to its canonical form.  In each
    connected component an explicit allow on any url frees every alias without a
    rule of its own; else an explicit block on any url blocks them.

    A null url or one without ``://`` has empty host and path, no rule and no
    alias, and is allowed.  Of rules of one length that fit, equal ones by name,
    allow goes first.  Repeated pages each get a row; null html links nothing;
    an empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    url = F.col("url")
    source = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        (F.col(html_col) if html_col else F.lit(None).cast("string")).alias("html"),
    )
    host, path = host_of(url), path_of(url)
    links = declared_links(url, F.col("html"))
    table = materialize(
        source.select("page_id", "url", host.alias("host"), path.alias("path"), links[0].alias("canonical"), links[1].alias("refresh")),
        "url-pages",
    )
    table = table.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    known = table.filter("host <> ''")
    edges = known.select(url.alias("src"), F.explode(F.array(canonical_form(url), "canonical", "refresh")).alias("dst"))
    if redirects is not None:
        edges = edges.unionAll(redirects.select("src", "dst"))
    with temporary(pages.sparkSession) as write:
        labels = connected_components(edges, "url", write)
        # A target may carry a rule without being a page itself.
        node = F.col("node")
        ruled = labels.withColumn("hit", matching_rule(host_of(node), path_of(node), rules))
        flags = write(
            ruled.groupBy("component")
            .agg(F.max(F.col("hit.action") == "allow").alias("freed"), F.max(F.col("hit.action") == "block").alias("barred"))
            .filter("freed or barred"),
            "url-flags",
        )
        decided = materialize(labels.join(flags, "component", "left"), "url-decided")
    joined = table.join(decided, table["url"] == decided["node"], "left")
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(
            F.col("hit.action"),
            F.when(F.col("freed"), F.lit("allow")).when(F.col("barred"), F.lit("block")).otherwise(F.lit("allow")),
        ).alias("verdict"),
        F.col("component"),
    )


#: Fixed rules of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: For tables whose pages declare no links: the only edges are those from a url to its canonical form.
URL_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1),
           '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS q
  FROM pages),
r(action, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
u AS (
  SELECT p.*, 'https://' || host || regexp_replace(path, '(\.html|/)$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canon FROM p),
n AS (SELECT DISTINCT canon AS comp, canon AS node FROM u WHERE host <> '' UNION SELECT canon, url FROM u WHERE host <> ''),
h AS (
  SELECT comp, node, translate(regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM n),
c AS (
  SELECT comp, max(action = 'allow') AS freed, max(action = 'block') AS barred FROM (
    SELECT comp, node, arg_max(action, length(rule)) AS action
    FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2) GROUP BY 1),
m AS (
  SELECT page_id, url, host, path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2, 3, 4)
SELECT u.page_id, u.host, u.path, m.rule,
       coalesce(m.action, CASE WHEN c.freed THEN 'allow' WHEN c.barred THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m ON m.page_id IS NOT DISTINCT FROM u.page_id AND m.url IS NOT DISTINCT FROM u.url LEFT JOIN c ON c.comp = u.canon
"""
