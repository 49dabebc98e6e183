"""5. URL filters by redirect equivalence.

Rules (action, host, path) fit a host and its subdomains where the path starts with the rule's path; the longest fitting
rule decides.  A url that no rule fits takes the decision of its aliases: urls linked to it by redirects (meta refresh in
the page, or rows of a redirect table) or canonical links, in any number of steps.  In such a component an explicit allow
wins over any block; a component without rules is allowed.

Only DataFrame functions are used.  Rules are part of the plan, and their number is checked (`MOST_RULES`); links and
components stay distributed, and only pages with links or named by links enter the component search.

Targets of links are resolved against the page's own url: absolute, //host/path, /path, ?query and relative ones, with dot
segments removed and &amp; read as &; other schemes (mailto:, data:) are no links, and a fragment alone is the page itself.

Defined cases: a null url or one without "://" has empty host and path, fits no rule, has no aliases and is allowed; a
null html has no links; repeated pages each get their row, and the links of all of them count; a very long html is searched
whole; of rules that tie in length the later one in the list holds; an empty table gives an empty result.  Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_columns_of, written
from .components import components

#: Action, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, action), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; a plan takes {MOST_RULES}")
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def address(url: Column) -> Column:
    """A url as a node: host in lower case, no fragment; null where there is no "://"."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), rest))


def resolved(url: Column, target: Column) -> Column:
    """The target of a link as an absolute url; null if it is none."""
    t = F.trim(F.replace(F.replace(target, F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&")))
    scheme, host = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path, top = path_of(url), F.concat(scheme, F.lit("://"), host)
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise("/")
    rest = lambda p: F.regexp_extract(p, r"(?s)^[^?#]*(.*)$", 1)
    made = F.when(t.startswith("/"), t).otherwise(F.concat(folder, t))
    return (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t)).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (t == "") | t.startswith("#"), F.lit(None).cast("string"))
        .when(t.startswith("?"), F.concat(top, path, t)).otherwise(F.concat(top, without_dots(F.regexp_extract(made, r"(?s)^([^?#]*)", 1)), rest(made)))
    )


def without_dots(path: Column) -> Column:
    """A path that begins with / without its segments . and .. (which takes the one before it away)."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    # an empty end stands for a folder, as . and .. at the end do
    parts = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): a page's address and the address that its html names as canonical or redirects to."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)
    tag = F.col("tag")
    # in quotes a value goes up to the same quote
    value = lambda name: F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*{v}""", 1), F.lit("")) for v in ('"([^"]*)"', "'([^']*)'", r"""([^"'>\s]+)""")])
    to = F.regexp_replace(F.regexp_extract(value("content"), r"(?is)\burl\s*=\s*(.+)$", 1), "^[\"']|[\"']$", "")
    goes = F.when(tag.rlike(r"""(?is)\brel\s*=\s*["']?canonical\b"""), value("href")).when(tag.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""), F.nullif(to, F.lit("")))
    links = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(tags).alias("tag"))
    return links.select(address(F.col("url")).alias("a"), address(resolved(F.col("url"), goes)).alias("b")).where("a is not null and b is not null and a <> b")


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, alias (root of the component, or null) of every row of pages.

    redirects may give further links as (source, target) urls.
    """
    pages = with_columns_of(pages, ("page_id", "long"), ("url", "string"), ("html", "string"))
    links = page_links(pages)
    if redirects is not None:
        more = with_columns_of(redirects, ("source", "string"), ("target", "string"))
        links = links.unionByName(more.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")))
    links = written(links.distinct())
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if links.isEmpty():
        return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias"))
    nodes = written(components(links))
    own = nodes.withColumn("r", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    said = own.groupBy("root").agg(F.max(F.col("r.action") == "allow").alias("allow"), F.max(F.col("r.action") == "block").alias("block"))
    said = written(said.select(F.col("root").alias("root0"), F.when(F.col("allow"), "allow").when(F.col("block"), "block").otherwise("allow").alias("shared")))
    by = nodes.join(said, F.col("root") == F.col("root0")).select(F.col("node"), F.col("root").alias("alias"), "shared")
    # urls without an address are dealt by their page, not all to one task; no node begins with a space
    at = F.coalesce(address(F.col("url")), F.concat(F.lit(" "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    out = judged.join(by, at == F.col("node"), "left")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", "shared", F.lit("allow")).alias("verdict"), "alias")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
