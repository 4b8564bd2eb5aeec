"""URL rules whose block decisions follow redirects and canonical links. DataFrame functions only.

A rule fits its host and all subdomains if the path of the url starts with the rule's path; the longest rule
(host and path together) wins. Pages that no rule fits get the decision of their equivalence class: urls that
redirects and canonical links join, however long the chain. In a class an explicit allow goes before a block,
and a class without either is allowed. Links are read from tags outside comments and scripts, with their entities decoded, and
resolved against the page's url or its base tag; urls are the same node if they differ in the case of scheme and host, a default
port, dot segments or the fragment only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, joined, once
from lectern.llm.components import connected_components

#: Up to so many rules are compiled into the plan, where they cost no shuffle; more would make the plan too long and are joined by host.
RULES_IN_PLAN = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z in lower case; '' without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def _fits(host: Column, path: Column, rule: dict) -> Column:
    return ((host == rule["host"]) | host.endswith("." + rule["host"])) & path.startswith(rule["path"])


def matched(urls: DataFrame, rules: list[dict] | DataFrame) -> DataFrame:
    """urls (host, path and any other columns) with rule and rule_verdict, null where no rule fits.

    rules: host, path, verdict. Of rules of one length the one with the longer host wins, then the lesser string.
    """
    if isinstance(rules, DataFrame):
        small = rules.limit(RULES_IN_PLAN + 1).collect()
        if len(small) > RULES_IN_PLAN:
            return _matched_by_join(urls, rules)
        rules = [r.asDict() for r in small]
    order = sorted(rules, key=lambda r: (-len(r["host"] + r["path"]), -len(r["host"]), r["host"] + r["path"]))
    none = F.lit(None).cast("string")
    rule = F.coalesce(*[F.when(_fits(F.col("host"), F.col("path"), r), r["host"] + r["path"]) for r in order], none)
    verdict = F.coalesce(*[F.when(_fits(F.col("host"), F.col("path"), r), r["verdict"]) for r in order], none)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def _matched_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for any number of rules: every suffix of a host is looked up among the rules' hosts."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = (
        urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
        .join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict"), "suffix")
        .where(F.col("path").startswith(F.col("prefix")))
        .select("host", "path", (rule := F.concat("suffix", "prefix")).alias("rule"), F.col("verdict").alias("rule_verdict"),
                F.struct(-F.length(rule), -F.length("suffix"), rule).alias("rank"))
    )
    best = fit.groupBy("host", "path").agg(F.min_by(F.struct("rule", "rule_verdict"), "rank").alias("best"))
    return urls.join(best.select("host", "path", "best.*"), ["host", "path"], "left")


def _without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    step = lambda done, x: (
        F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    )
    segments = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    last = F.when(path.rlike(r"/\.{1,2}\z"), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(?:/|\z)"), F.concat(F.array_join(segments, "/"), last)).otherwise(path)


def _decoded(text: Column) -> Column:
    """A path or query whose escapes of unreserved characters are these characters; other escapes are in capitals."""

    def piece(x: Column) -> Column:
        code, rest = F.upper(F.substring(x, 1, 2)), F.substring(x, 3, 2**31 - 1)
        char = F.chr(F.conv(code, 16, 10).cast("long"))
        escape = F.when(char.rlike(r"^[A-Za-z0-9._~\-]\z"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), code, rest))
        return F.when(x.rlike("^[0-9A-Fa-f]{2}"), escape).otherwise(F.concat(F.lit("%"), x))

    whole = lambda p: F.concat(p[0], F.array_join(F.transform(F.slice(p, 2, F.size(p)), piece), ""))
    return F.when(text.rlike("%[0-9A-Fa-f]{2}"), once(F.split(text, "%"), whole)).otherwise(text)


_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def node_of(url: Column) -> Column:
    """A url as a node: trimmed, scheme and host in lower case, without default port, needless escapes, dot segments and fragment; an empty path is /."""

    def whole(own: Column) -> Column:
        part = lambda i: F.regexp_extract(own, _PARTS, i)
        parts = F.struct(F.translate(part(1), UPPER, LOWER).alias("scheme"), F.translate(part(2), UPPER, LOWER).alias("host"), _decoded(part(3)).alias("path"), _decoded(part(4)).alias("query"))
        return F.when(own.rlike(_PARTS), once(parts, joined_up)).otherwise(F.regexp_replace(own, r"(?s)#.*\z", ""))

    def joined_up(p: Column) -> Column:
        port = F.when(p["scheme"] == "http", r":(?:80)?\z").when(p["scheme"] == "https", r":(?:443)?\z").otherwise(r":\z")
        return F.concat(p["scheme"], F.lit("://"), F.regexp_replace(p["host"], port, F.lit("")), F.when(p["path"] == "", "/").otherwise(_without_dots(p["path"])), p["query"])

    return once(F.trim(url), whole)


def _absolute(link: Column, base: Column) -> Column:
    """A link as the page at base means it; dot segments are left to node_of."""
    return once(F.struct(link.alias("link"), base.alias("base")), lambda x: _resolved(x["link"], x["base"]))


def _resolved(link: Column, base: Column) -> Column:
    origin, path = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*)", 1), F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]*:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .when(link.startswith("#"), base)
        .otherwise(F.concat(origin, folder, link))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute with its entities decoded, quoted or not; '' if it has none."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    for entity, char in ((r"quot|#34|#x0*22", '"'), (r"apos|#39|#x0*27", "'"), (r"lt|#60|#x0*3c", "<"), (r"gt|#62|#x0*3e", ">"), (r"sol|#47|#x0*2f", "/"), (r"colon|#58|#x0*3a", ":"), (r"amp|#38|#x0*26", "&")):
        value = F.regexp_replace(value, rf"(?i)&(?:{entity});", char)
    return F.trim(F.regexp_replace(value, r"[\t\n\r]", " "))


def _link_of(tag: Column) -> Column:
    """What a tag links to if it is a canonical link or a refresh, else null or ''."""
    canonical = tag.rlike(r"(?i)^<link\b") & F.lower(_attribute(tag, "rel")).rlike(r"(?:^|\s)canonical(?:\s|\z)")
    refresh = tag.rlike(r"(?i)^<meta\b") & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
    to = F.regexp_extract(_attribute(tag, "content"), r"(?is)^\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?[\"']?\s*([^\"'\s]+)", 1)
    return F.when(canonical, _attribute(tag, "href")).when(refresh, to)


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of every canonical link and refresh redirect in pages (url, html).

    Tags may go over several lines and hold > in quotes; rel may list several words. What stands in comments, and in elements whose content is text or isn't part of the page, is no tag.
    """
    may = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    html = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|noscript|xmp)\b.*?(?:</\1\s*>|\z)", " ")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta|base)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>)"), 1)
    base = lambda t: F.nullif(_attribute(F.coalesce(F.get(F.filter(t, lambda x: x.rlike(r"(?i)^<base\b")), F.lit(0)), F.lit("")), "href"), F.lit(""))
    # All of a page's links in one expression, in which each value is computed once.
    links = lambda t: F.struct(base(t).alias("base"), F.filter(F.transform(t, _link_of), lambda x: x != "").alias("links"))
    found = may.select("url", once(tags, links).alias("l")).select("url", F.col("l.base").alias("base"), F.explode("l.links").alias("link"))
    of = F.coalesce(_absolute(F.col("base"), F.col("url")), "url")
    return found.select(node_of(F.col("url")).alias("src"), node_of(_absolute(F.col("link"), of)).alias("dst"))


def judged(pages: DataFrame, rules: list[dict] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the node that stands for the page's class (null: in no class).

    pages: page_id, url, html. redirects: further edges (src, dst) of urls, from a crawl's log. A null url has an
    empty host and path, fits no rule and belongs to no class, so it is allowed. Repeated rows are each judged.
    Only urls that an edge names are sent through the components; class decisions are joined back by url.
    """
    own = matched(pages.select("page_id", node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))))
    classes = connected_components(edges)
    decided = matched(classes.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    of_class = decided.groupBy("component").agg(
        F.when(F.bool_or(F.col("rule_verdict") == "allow"), "allow").when(F.bool_or(F.col("rule_verdict") == "block"), "block").alias("class_verdict")
    )
    known = cut(joined(classes.withColumnRenamed("component", "__class"), of_class.withColumnRenamed("component", "__class"), "__class")).withColumnRenamed("__class", "component")
    return joined(own.withColumn("node", F.coalesce("node", F.lit(""))), known, "node").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("verdict"), F.col("component").alias("class_url")
    )
