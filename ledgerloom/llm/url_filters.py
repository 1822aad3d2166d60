"""URL filters by host and path rules, and by what an address redirects to.

A rule fits its host and all subdomains where the path starts with the rule's; of
several the longest decides. Addresses that no rule fits are judged by their
redirect group: addresses linked by redirects, by the canonical links and refresh
marks of their pages, or given as a table. A group holding a blocked address is
blocked, wherever in the chain that address is, and whether its page is in the table
or not. An allowed address stays allowed and passes no block on: its links
are cut before groups are made, so a blocked page that redirects to an allowed one
doesn't drag along what else points there.

Scale: the pages are scanned once for addresses and link targets; only these are
written. Rules are looked up for distinct hosts (by their suffixes), never for rows;
groups are connected components in written turns, whose joins AQE can split at hubs;
what is broadcast is summed up first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, SPACES, UPPER, let, materialize, small_enough
from ledgerloom.llm.components import components

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BROADCAST_BYTES = 32 << 20
TAG = r"(?i)<(?:link|meta)\b[^<>]*>"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


# ------------------------------------------------------------------ addresses
def host_and_path(url: Column) -> dict[str, Column]:
    """``host``, ``path`` and ``query`` (with its ?) of a url; all empty for a null one
    and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return {
        "host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1),
    }


def rooted(path: Column) -> Column:
    return F.when(path == "", "/").otherwise(path)


def node(host: Column, path: Column, query: Column) -> Column:
    """What an address is known by: scheme and fragment don't tell addresses apart,
    nor does an empty path from the root. Null without a host."""
    return F.when(host != "", F.md5(F.concat(host, rooted(path), query).cast("binary")))


def address(url: Column) -> Column:
    """host, path and node of a url."""
    return let(F.struct(*[c.alias(n) for n, c in host_and_path(url).items()]), lambda p: F.struct(p["host"].alias("host"), p["path"].alias("path"), node(p["host"], p["path"], p["query"]).alias("node")))


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, in either quotes or none; empty if it has none."""
    pattern = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def link_targets(html: Column) -> Column:
    """References of the canonical links and refresh marks of a page, as they stand."""

    def target(tag: Column) -> Column:
        canonical = tag.rlike("(?i)^<link") & attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
        refresh = tag.rlike("(?i)^<meta") & attribute(tag, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")
        after = F.regexp_extract(attribute(tag, "content"), r"""(?i)^[\s\d.]*[;,]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1)
        return F.btrim(F.replace(F.when(canonical, attribute(tag, "href")).when(refresh, after), F.lit("&amp;"), F.lit("&")), F.lit(SPACES))

    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAG), F.lit(0))
    return F.filter(F.transform(tags, target), lambda x: x.isNotNull() & ~x.rlike("^(#|$)"))


def resolved(reference: Column, host: Column, path: Column) -> Column:
    """The url that a reference on a page at ``host`` and ``path`` stands for; null for
    other schemes than those with ``://``. Dot segments are left as they are."""
    site = F.concat(F.lit("http://"), host)
    folder = F.regexp_replace(rooted(path), "[^/]*$", "")
    return (
        F.when(reference.rlike(SCHEME + "//"), reference)
        .when(reference.rlike(SCHEME), None)
        .when(F.startswith(reference, F.lit("//")), F.concat(F.lit("http:"), reference))
        .when(F.startswith(reference, F.lit("/")), F.concat(site, reference))
        .when(F.startswith(reference, F.lit("?")), F.concat(site, path, reference))
        .otherwise(F.concat(site, folder, reference))
    )


# ------------------------------------------------------------------ rules
def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """(host, path, verdict) as a table."""
    each = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), rule, strict=True)]) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*each)))


def suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _joined(left: DataFrame, table: DataFrame, keys: list[str], how: str, row_bytes: Column) -> DataFrame:
    return left.join(F.broadcast(table) if small_enough(table, row_bytes, BROADCAST_BYTES) else table, keys, how)


def judged(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``places`` (host, path, ...) with ``rule`` and its ``verdict``, null where none
    fits, and ``known``, the verdict on the address (an empty path leads to the
    root). Of rules of one length that of the longer host wins, then a block."""
    rules = materialize(rules.select(F.col("host").alias("suffix"), F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("hosts"), F.col("verdict"), F.col("path").alias("from"), F.concat("host", "path").alias("rule")).alias("r")), "rules")
    hosts = places.where("host <> ''").select("host").distinct()
    known = _joined(hosts.select("host", F.explode(suffixes(F.col("host"))).alias("suffix")), rules, ["suffix"], "inner", F.length("suffix") + F.length("r.rule") + 64)
    known = materialize(known.groupBy("host").agg(F.collect_list("r").alias("rules")), "ruled_hosts")
    found = _joined(places, known, ["host"], "left", F.length("host") + F.aggregate("rules", F.lit(0), lambda n, r: n + F.length(r["rule"]) + 64))
    best = lambda path: F.array_max(F.filter("rules", lambda r: F.startswith(path, r["from"])))
    found = found.withColumns({"best": best(F.col("path")), "best_known": best(rooted(F.col("path")))})
    return found.select(*places.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"), F.col("best_known.verdict").alias("known"))


# ------------------------------------------------------------------ groups
def filter_urls(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, html) -> page_id, host, path, rule, verdict (allow or block).

    ``rules`` has host, path, verdict; ``redirects`` source and target urls that a
    crawl has seen; without a column ``html`` only these link. What neither a rule
    fits nor a blocked group holds is allowed, a null, empty or odd url among them
    (host and path are then empty and it is in no group). Repeated rows are judged
    alike, each returned; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    targets = link_targets(F.col("html")) if "html" in pages.columns else F.array().cast("array<string>")
    parts = pages.select("page_id", *[c.alias(n) for n, c in host_and_path(F.col("url")).items()], targets.alias("targets"))
    seen = materialize(parts.select("page_id", "host", "path", node(F.col("host"), F.col("path"), F.col("query")).alias("node"), "targets"), "addresses")
    own = judged(seen, rules)
    blocked = blocked_nodes(seen, rules, redirects)
    verdict = F.coalesce("verdict", "known", F.when(F.col("in_group"), "block"), F.lit("allow"))
    return _joined(own, blocked.withColumn("in_group", F.lit(True)), ["node"], "left", F.lit(48)).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def blocked_nodes(seen: DataFrame, rules: DataFrame, redirects: DataFrame | None) -> DataFrame:
    """``node`` of all addresses in a group that holds a blocked one; written."""
    c = F.col
    on_pages = seen.where("node is not null").select("host", "path", "node", F.explode("targets").alias("reference"))
    links = on_pages.select(F.struct("host", "path", "node").alias("a"), address(resolved(c("reference"), c("host"), c("path"))).alias("b"))
    if redirects is not None:
        links = links.unionByName(redirects.select(address(c("source")).alias("a"), address(c("target")).alias("b")))
    links = materialize(links.where("a.node <> b.node").distinct(), "redirects")
    ends = links.select(F.inline(F.array("a", "b"))).distinct()
    ruled = materialize(judged(ends, rules).where("known is not null").select("node", "known").distinct(), "ruled_addresses")
    pairs = links.select(c("a.node").alias("a"), c("b.node").alias("b"))
    allowed = ruled.where("known = 'allow'").select("node")
    for end in ("a", "b"):
        pairs = _joined(pairs, allowed.select(c("node").alias(end)), [end], "left_anti", F.lit(48))
    groups = materialize(components(pairs), "groups")
    starts = ruled.where("known = 'block'").select("node")
    bad = materialize(_joined(groups, starts, ["node"], "left_semi", F.lit(48)).select("component").distinct(), "blocked_groups")
    return materialize(_joined(groups, bad, ["component"], "left_semi", F.lit(48)).select("node").distinct(), "blocked")
