"""Url filters with decisions that spread over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import settle
from cellgauge.llm.components import components
from cellgauge.operators.joins import fits, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (verdict, host, path)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Rules are a parameter, compared in turn
    from the longest."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def rules_met(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and hit (struct of rule and verdict) of each distinct ``url`` that one of ``rules`` (verdict, host, path) fits, the
    longest, by equi joins: for block lists of any length.

    A host meets rules by its last labels, as many as the deepest rule has; then, for each length of path that the
    rules of that host have, by the path's beginning. So a url meets at most one rule for each pair of these."""
    rules = rules.select("verdict", F.col("host").alias("_host"), F.col("path").alias("_path")).distinct()
    rules = settle(rules.where("verdict IS NOT NULL AND _host IS NOT NULL AND _path IS NOT NULL"), "url-rules")
    lengths = rules.select("_host", F.char_length("_path").alias("_length")).distinct()
    deepest = rules.agg(F.max(F.size(F.split("_host", r"\."))).alias("n")).first()["n"] or 0
    asked = urls.where("url IS NOT NULL").select("url").distinct()
    asked = asked.select("url", host_of(F.col("url")).alias("_of"), path_of(F.col("url")).alias("_at"))
    tails = F.expr(f"transform(sequence(1, {max(deepest, 1)}), n -> substring_index(_of, '.', -n))")
    hosts = asked.select("url", "_at", F.explode(F.array_distinct(tails)).alias("_host"))
    salt = F.xxhash64("url")
    met = spread_join(hosts, lengths, ["_host"], "inner", salt).where(F.char_length("_at") >= F.col("_length"))
    begun = met.select("url", "_host", F.expr("substring(_at, 1, _length)").alias("_path"))
    found = spread_join(begun, rules, ["_host", "_path"], "inner", salt)
    rule = F.concat("_host", "_path")
    # The longest; of equal length the first by verdict, host and path, as in a list of rules.
    best = F.min(F.struct(-F.char_length(rule), "verdict", "_host", "_path", rule.alias("rule"))).alias("_best")
    return found.groupBy("url").agg(best).select("url", F.struct("_best.rule", "_best.verdict").alias("hit"))


def with_rules(urls: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """``urls`` with a column ``_hit``, null where no rule fits the ``url``. A list of rules becomes one expression; a table
    is joined."""
    if not isinstance(rules, DataFrame):
        return urls.withColumn("_hit", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules))
    hits = settle(rules_met(urls, rules).select("url", "hit.rule", "hit.verdict"), "url-rules-met")
    told = hits.withColumnsRenamed({"rule": "_rule", "verdict": "_verdict"})
    joined = spread_join(urls, told, ["url"], "left", F.monotonically_increasing_id(), small_fits=fits(told))
    hit = F.when(F.col("_verdict").isNotNull(), F.struct(F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict")))
    return joined.withColumn("_hit", hit).drop("_rule", "_verdict")


def node_of(url: Column) -> Column:
    """Digest of a url without its scheme and fragment, which no server tells apart here: its node in the alias graph. 128
    bits, so that two of 10^10 urls share one with odds of 10^-19."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.md5(F.encode(F.concat(host_of(url), rest), "UTF-8"))


def links_of(html: Column) -> Column:
    """Targets of canonical links and meta refreshes in a page, as written."""
    html = F.coalesce(html, F.lit(""))
    quoted = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    tags = F.concat(
        F.filter(
            F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0),
            lambda t: F.regexp_like(t, F.lit(r"""(?is)\brel\s*=\s*["']?\s*canonical\b""")),
        ),
        F.filter(
            F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0),
            lambda t: F.regexp_like(t, F.lit(r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b""")),
        ),
    )

    def target(t: Column) -> Column:
        href = F.concat(*(F.coalesce(F.regexp_extract(t, r"(?is)\bhref" + quoted, g), F.lit("")) for g in (1, 2, 3)))
        refresh = F.regexp_extract(t, r"""(?is)\burl\s*=\s*['"]?([^'">\s]+)""", 1)
        return F.trim(F.when(F.lower(t).startswith("<link"), href).otherwise(refresh))

    found = F.filter(F.transform(tags, target), lambda x: x != "")
    # Most pages have no such tag; two cheap searches spare them the patterns.
    low = F.lower(html)
    return F.when(low.contains("canonical") | low.contains("refresh"), found).otherwise(F.array().cast("array<string>"))


def resolved(base: Column, link: Column) -> Column:
    """A link of a page as an absolute url."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(F.regexp_like(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(site, path_of(base), link))
        .otherwise(F.concat(site, folder, link))
    )


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url, html). ``rules`` is a
    list, or a table (verdict, host, path) of any size.

    A url that a rule fits has that rule's verdict, always. Other urls take the decision of their aliases:
    redirects (``redirects``: src, dst; and meta refreshes) and canonical links are edges between urls
    without scheme and fragment, and a connected component that holds a blocked url is blocked, unless it
    also holds an explicitly allowed one; without either it is allowed. Urls that are only the target of a
    link count with their own rule, whether or not they are pages.

    Null url or one without ``://``: host and path empty, no rule, no alias, allow. Null html: no links. Empty rules: all
    allowed. Repeated pages get equal verdicts; an empty table gives no rows."""
    page = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    page = with_rules(page, rules)
    links = pages.where(F.col("url").contains("://")).select("url", F.explode(links_of(F.col("html"))).alias("link"))
    edges = links.select(F.col("url").alias("src"), resolved(F.col("url"), F.col("link")).alias("dst"))
    if redirects is not None:
        edges = edges.union(redirects.where("src LIKE '%://%' AND dst LIKE '%://%'").select("src", "dst"))
    edges = settle(edges.distinct(), "url-links")
    ends = edges.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b"))
    roots = components(ends)
    known = edges.select(F.col("src").alias("url")).union(edges.select("dst")).distinct()
    told = with_rules(known, rules).select(node_of(F.col("url")).alias("node"), F.col("_hit.verdict").alias("_told"))
    # What each component was told; a plain aggregate, so the size of a component does not matter.
    decided = (
        roots.join(told.where(F.col("_told").isNotNull()), "node")
        .groupBy("root")
        .agg(F.max(F.col("_told") == "allow").alias("_allow"))
    )
    spread = roots.join(decided, "root").select("node", F.when(F.col("_allow"), "allow").otherwise("block").alias("_spread"))
    node = F.when(F.col("url").contains("://"), node_of(F.col("url")))
    return (
        page.withColumn("node", node)
        .join(spread, "node", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("_hit.rule").alias("rule"),
            F.coalesce("_hit.verdict", "_spread", F.lit("allow")).alias("verdict"),
        )
    )
