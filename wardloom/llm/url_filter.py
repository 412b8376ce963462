"""URL filters that hold for every alias of an address.

Redirects and canonical links are edges between addresses; addresses connected by them are one page. A rule decides the
addresses it fits. An address without a rule takes the decision of its component: allow if any address in it is
allowed by a rule, else block if any is blocked, else allow.

All of it is SQL functions and joins. Edges come from the pages' own canonical links and refresh instructions, from a table of
redirects if there is one, and from the steps by which servers commonly redirect: to one scheme without the fragment,
without tracking parameters, without a leading ``www`` or mobile host and without a closing slash or ``.html``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.llm.work import components, saved, take

# (verdict, host, path): a host with all its subdomains, and how the path begins
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
TRACKING = "(^|&)(utm_[^&=]*|ref|gclid|fbclid)=[^&]*"
TAGS = r"(?i)<(?:link|meta)[\s/][^>]*>"
VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "(?s)^[^/?#]*([^?#]*)", 1)


def _query(url: Column) -> Column:
    kept = F.regexp_replace(F.regexp_extract(_rest(url), r"(?s)^[^?#]*\?([^#]*)", 1), TRACKING, "")
    kept = F.regexp_replace(kept, "^&", "")
    return F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))


def aliases(url: Column) -> list[Column]:
    """The addresses that the usual redirects lead to, one after the other."""
    host, path = host_of(url), path_of(url)
    whole = F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^#]*)", 1)
    plain_host = F.regexp_replace(host, r"^(www|m|amp)\.(?=[^.]+\.)", "")
    plain_path = F.regexp_replace(F.regexp_replace(path, r"(index)?\.html?$", ""), "/+$", "")
    return [
        F.concat(F.lit("https://"), host, whole),
        F.concat(F.lit("https://"), host, path, _query(url)),
        F.concat(F.lit("https://"), plain_host, plain_path, _query(url)),
    ]


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, null without one. Rules are a list in the plan: keep it to thousands."""
    by_host: dict[str, list] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append(
            F.struct(F.lit(len(rule_host + rule_path)).alias("size"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(rule_path).alias("path"))
        )
    table = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    labels = F.split(host, "\\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = F.flatten(F.filter(F.transform(endings, lambda e: table[e]), lambda found: found.isNotNull()))
    fit = F.filter(fit, lambda r: F.startswith(path, r["path"]))
    return F.array_max(fit)


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; empty without one."""
    found = F.regexp_extract(tag, rf"""(?i)[\s"'/]{name}\s*=\s*{VALUE}""", 1)
    quoted = found.rlike("""^["']""")
    return F.trim(F.when(quoted, F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found))


def resolved(base: Column, target: Column) -> Column:
    """A link's address as seen from the page ``base``; null where it leads to no other page."""
    scheme = F.substring_index(base, "://", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(base), "^[^/?#]*", 0))
    folder = F.regexp_extract(path_of(base), "(?s)^.*/", 0)
    folder = F.when(folder == "", "/").otherwise(folder)
    way = F.regexp_extract(target, "(?s)^[^?#]*", 0)
    whole = F.when(F.startswith(way, F.lit("/")), way).otherwise(F.concat(folder, way))
    steps = F.split(F.substring(whole, 2, 1 << 30), "/")
    plain = F.aggregate(
        steps, F.lit(""),
        lambda done, step: F.when(step == "..", F.regexp_replace(done, "/[^/]*$", "")).when(step == ".", done).otherwise(F.concat(done, F.lit("/"), step)),
    )
    tail = F.regexp_extract(target, "(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(target.rlike("(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.rlike("(?i)^[a-z][a-z0-9+.-]*:") | (target == "") | F.startswith(target, F.lit("#")), None)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("?")), F.concat(origin, path_of(base), target))
        .otherwise(F.concat(origin, plain, tail))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """``src, dst`` from all canonical links and refresh instructions, attributes in any order, relative addresses resolved."""
    tags = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(TAGS), 0)).alias("tag"))
    canonical = F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical")
    refresh = F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh"
    content = F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?i)url\s*=\s*["']?([^"']*)""", 1)
    is_link = F.lower(F.substring("tag", 2, 4)) == "link"
    target = F.when(is_link & canonical, _attribute(F.col("tag"), "href")).when(~is_link & refresh, F.trim(content))
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    found = tags.select("url", target.alias("target")).where("target IS NOT NULL")
    return found.select(F.col("url").alias("src"), resolved(F.col("url"), F.col("target")).alias("dst")).where("dst IS NOT NULL")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): ``page_id, host, path, rule, verdict``.

    redirects: ``src, dst``, whole addresses, may be absent. Other columns are ignored.

    A null url, or one without ``://``, has an empty host and path, no rule, no alias and is allowed. A rule for a host
    fits it and its subdomains. Repeated rows are judged each time. Null html has no links. Empty tables give an empty
    result. Addresses are told apart by 64-bit hashes.
    """
    pages = take(pages, page_id="long", url="string", html="string")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    # the wide column is read once
    links = link_edges(pages.where("url LIKE '%://%'"))
    if redirects is not None:
        links = links.union(take(redirects, src="string", dst="string").where("src LIKE '%://%' AND dst LIKE '%://%'"))
    links = saved(links.distinct(), "links")
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    rows = saved(
        rows.select("page_id", "url", "host", "path", "found.rule", "found.verdict", F.when(F.col("host") != "", F.xxhash64("url")).alias("node")),
        "addresses",
    )
    known = rows.where("node IS NOT NULL").select("url").union(links.select("src")).union(links.select("dst")).distinct()
    steps = F.array(F.col("url"), *aliases(F.col("url")))
    hops = known.select(F.explode(F.arrays_zip(F.slice(steps, 1, 3).alias("a"), F.slice(steps, 2, 3).alias("b"))).alias("hop"))
    edges = hops.select(F.xxhash64("hop.a").alias("a"), F.xxhash64("hop.b").alias("b")).union(links.select(F.xxhash64("src"), F.xxhash64("dst")))
    roots = components(edges.distinct())
    # addresses that are known only from links have rules too
    seen = known.select(F.xxhash64("url").alias("node"), rule_for(host, path, rules)["verdict"].alias("verdict")).where("verdict IS NOT NULL")
    decided = seen.join(roots, "node").groupBy("root").agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"))
    method = roots.join(decided, "root").select("node", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("method"))
    return rows.join(method, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "method", F.lit("allow")).alias("verdict")
    )
