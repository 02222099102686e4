"""URL filters: rules by host and path, and trust and distrust passed on over the links between hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, ascii_lower, join_skewed, packed, saved, table, unpacked

#: The rules of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A link to another host, in an address that names one.
LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"
#: Scores are whole numbers of this part, so that sums are the same in any order.
UNIT = 1_000_000_000


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; '' without."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end; '' without a host part."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and what it is a subdomain of, longest first."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _rules_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host that a rule fits, those rules, in the order in which they hold."""
    named = rules.select(ascii_lower(F.col("host")).alias("of"), "path", "verdict").dropDuplicates(["of", "path"])
    rule = F.struct((-F.length(F.concat("of", "path"))).alias("n"), (-F.length("of")).alias("m"), F.col("of").alias("host"), "path", "verdict")
    lists = named.groupBy("of").agg(F.sort_array(F.collect_list(rule)).alias("own"))
    spread = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("of"))
    lists = saved(lists.join(spread.groupBy("of").agg(F.count("*").alias("n")), "of"))
    met = join_skewed(spread, lists, ["of"], "n", ["own"], F.xxhash64("host"), inner=True)
    return met.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("rules"))


def _kin(hosts: DataFrame) -> DataFrame:
    """(src, dst, w): each host and the nearest one that it is a subdomain of, both ways."""
    up = hosts.select("host", F.explode(F.slice(suffixes(F.col("host")), 2, 1_000)).alias("of"))
    known = saved(up.groupBy("of").agg(F.count("*").alias("n")).join(hosts.select(F.col("host").alias("of")), "of"))
    near = join_skewed(up, known, ["of"], "n", [], F.xxhash64("host"), inner=True).groupBy("host").agg(F.max(F.struct(F.length("of").alias("n"), "of")).alias("x"))
    pair = F.array(F.struct(F.col("host").alias("src"), F.col("x.of").alias("dst")), F.struct(F.col("x.of").alias("src"), F.col("host").alias("dst")))
    return near.select(F.explode(pair).alias("e")).select("e.src", "e.dst", F.lit(1).cast("long").alias("w"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """hosts (host, allow, block: seeds, whole numbers) with trust and distrust, by personalised PageRank over edges (src, dst, w).

    Trust starts at `allow` and goes along the links, by their weights; distrust starts at `block` and goes against them,
    so it comes to those that link to what is blocked. A score is (1 - damping) of the seed and damping of what comes in;
    what a host without links would pass on is lost. Products are rounded down to whole numbers. A host with many links
    (over a thousandth of all) gets its score by a broadcast of those hosts; sums are combined before they are dealt out.
    """
    edges = edges.filter("src <> dst")
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "w").unionByName(edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    out = saved(both.groupBy("kind", "src").agg(F.sum("w").alias("of"), F.count("*").alias("n")))
    # of all links, a hot host has over a thousandth: there are fewer than a thousand such hosts a kind, whatever the data
    is_hot = F.col("n") > (out.agg(F.sum("n")).first()[0] or 0) / 1000
    both = saved(join_skewed(both, out, ["kind", "src"], "n", ["of", "n"], F.col("dst")).select("kind", "src", "dst", (F.col("w") / F.col("of")).alias("share"), is_hot.alias("hot")))
    seed = hosts.select("host", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("seed")) for k in ("allow", "block")))).alias("x")).select(F.col("host").alias("src"), "x.*")
    own = saved(seed.join(out, ["kind", "src"], "left").select("kind", "src", F.floor((1 - damping) * F.col("seed")).alias("own"), F.coalesce(is_hot, F.lit(False)).alias("hot")))
    score = own.select("kind", "src", F.col("own").alias("score"), "hot")
    cold, hot = both.filter("not hot").drop("hot"), both.filter("hot").drop("hot")
    for i in range(rounds):
        sent = cold.join(score.filter("not hot"), ["kind", "src"]).unionByName(hot.join(F.broadcast(score.filter("hot")), ["kind", "src"]))
        come = sent.groupBy("kind", F.col("dst").alias("src")).agg(F.sum(F.floor(damping * F.col("score") * F.col("share"))).alias("come"))
        score = own.join(come, ["kind", "src"], "left").select("kind", "src", (F.col("own") + F.coalesce("come", F.lit(0))).alias("score"), "hot")
        if i % 4 == 3 or i == rounds - 1:
            score = saved(score)
    sums = score.groupBy(F.col("src").alias("host")).agg(*(F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(a) for k, a in (("allow", "trust"), ("block", "distrust"))))
    return hosts.join(sums, "host")


def url_filter(pages: DataFrame, rules: DataFrame, damping: float = 0.85, rounds: int = 20, least: float = 0.5, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages without the html, with host, path, rule, verdict, trust and distrust.

    rules: (host, path, verdict), any number. A rule fits its host and all subdomains of it, where the url's path starts with
    the rule's; the longest (host and path together, then host, then first by code point) holds, and is named as host and
    path. Repeated rules of one host and path: any one of them. Pages without a rule go by their host's score.

    The graph: a link from a page to another host in href or src (once a page and host, whatever its number), and a link
    both ways between a host and the nearest host of the table that it is a subdomain of. Seeds: the share of a
    host's pages that rules allow (trust) or block (distrust), in parts of UNIT. propagate() passes trust on along links and distrust back
    against them. A host is blocked if its distrust is more than its trust, and at least `least` of what a host gets that
    is blocked whole and has no links; so a host that nothing speaks against is allowed.

    Null urls and those without :// have neither host nor path; they are no part of the graph and are allowed. Null
    html: no links. Rows alike count as pages each. Columns of the names made here are replaced; others pass. Empty input:
    empty. The html is read once and not shuffled; hosts and links are counted before they are dealt out; hot hosts go by join_skewed().
    """
    base = packed(pages.drop(html_col), url_col).withColumn("_tz_host", host_of(F.col(f"_tz_{url_col}").cast("string"))).withColumn("_tz_path", path_of(F.col(f"_tz_{url_col}").cast("string")))
    found = base.filter("_tz_host <> ''").groupBy(F.col("_tz_host").alias("host")).agg(F.count("*").alias("pages"))
    hosts = saved(found)
    held = saved(hosts.join(_rules_of(hosts, rules), "host", "left"))
    met = join_skewed(base, held.filter("rules is not null").select(F.col("host").alias("_tz_host"), "pages", F.col("rules").alias("_tz_rules")), ["_tz_host"], "pages", ["_tz_rules"], F.xxhash64("_tz_path"))
    first = F.get(F.filter("_tz_rules", lambda r: F.startswith(F.col("_tz_path"), r["path"])), F.lit(0))
    met = saved(met.withColumn("_tz_rule", first).select("_tz_row", "_tz_host", "_tz_path", F.concat("_tz_rule.host", "_tz_rule.path").alias("_tz_name"), F.col("_tz_rule.verdict").alias("_tz_said")))

    seeds = met.filter("_tz_host <> ''").groupBy(F.col("_tz_host").alias("host")).agg(F.count("*").alias("pages"), *(F.floor(F.lit(UNIT) * F.count_if(F.col("_tz_said") == k) / F.count("*")).alias(k) for k in ("allow", "block")))
    from_ = host_of(F.col(f"`{url_col}`").cast("string"))
    to = F.array_distinct(F.transform(F.regexp_extract_all(F.col(f"`{html_col}`").cast("string"), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    links = pages.select(from_.alias("src"), F.explode(to).alias("dst")).filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    # hosts that are only linked to have no pages and no seeds, but pass scores on
    links = saved(links)
    others = links.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti")
    nodes = saved(seeds.unionByName(others.select("host", *(F.lit(0).cast("long").alias(c) for c in ("pages", "allow", "block")))))
    edges = links.unionByName(_kin(nodes)).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    scores = propagate(nodes, edges, damping, rounds).filter("pages > 0").select(F.col("host").alias("_tz_host"), "pages", F.col("trust").alias("_tz_trust"), F.col("distrust").alias("_tz_distrust"))
    done = join_skewed(met, saved(scores), ["_tz_host"], "pages", ["_tz_trust", "_tz_distrust"], F.xxhash64("_tz_path"))
    trust, distrust = (F.coalesce(c, F.lit(0)) for c in ("_tz_trust", "_tz_distrust"))
    blocked = (distrust > trust) & (distrust >= int(least * (1 - damping) * UNIT))
    verdict = F.coalesce("_tz_said", F.when(blocked, "block").otherwise("allow"))
    return unpacked(done, pages.drop(html_col), None, host=F.col("_tz_host"), path=F.col("_tz_path"), rule=F.col("_tz_name"), verdict=verdict, trust=trust / UNIT, distrust=distrust / UNIT)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES))
    rules = spark.range(1).select(F.inline(listed))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


#: The same in plain SQL: rules as literals, the rounds as a recursion.
ORACLE = r"""
WITH RECURSIVE parsed AS (
    SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
judged AS (
    SELECT page_id, html, host, path, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM parsed),
said AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS verdict FROM judged),
hosts AS (
    SELECT host, CAST(floor(1000000000 * count(*) FILTER (verdict = 'allow') / count(*)) AS BIGINT) AS allow, CAST(floor(1000000000 * count(*) FILTER (verdict = 'block') / count(*)) AS BIGINT) AS block
    FROM said WHERE host <> '' GROUP BY host),
links AS (
    SELECT src, dst, count(*) AS w FROM (
        SELECT DISTINCT page_id, n, src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM (
            SELECT page_id, row_number() OVER () AS n, host AS src, unnest(regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1)) AS dst FROM parsed))
    WHERE src <> '' AND src <> dst GROUP BY src, dst),
nodes AS (SELECT * FROM hosts UNION ALL SELECT DISTINCT dst, 0, 0 FROM links WHERE dst NOT IN (SELECT host FROM hosts)),
kin AS (SELECT a.host AS child, max_by(b.host, length(b.host)) AS parent FROM nodes a JOIN nodes b ON ends_with(a.host, '.' || b.host) GROUP BY a.host),
edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT child, parent, 1 FROM kin UNION ALL SELECT parent, child, 1 FROM kin) GROUP BY src, dst),
ways AS (
    SELECT kind, src, dst, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY kind, src) AS share
    FROM (SELECT 'allow' AS kind, src, dst, w FROM edges UNION ALL SELECT 'block', dst, src, w FROM edges)),
own AS (SELECT 'allow' AS kind, host, CAST(floor(CAST(0.15000000000000002 AS DOUBLE) * allow) AS BIGINT) AS own FROM nodes UNION ALL SELECT 'block', host, CAST(floor(CAST(0.15000000000000002 AS DOUBLE) * block) AS BIGINT) FROM nodes),
passed(round, kind, host, score) AS (
    SELECT 0, kind, host, own FROM own
    UNION ALL
    SELECT round, kind, host, CAST(sum(score) AS BIGINT) FROM (
        SELECT (SELECT max(round) FROM passed) + 1 AS round, kind, host, own AS score FROM own
        UNION ALL
        SELECT p.round + 1, p.kind, w.dst, CAST(floor(CAST(0.85 AS DOUBLE) * p.score * w.share) AS BIGINT) FROM passed p JOIN ways w ON w.kind = p.kind AND w.src = p.host)
    WHERE round <= 20 GROUP BY round, kind, host),
scores AS (SELECT host, max(score) FILTER (kind = 'allow') AS trust, max(score) FILTER (kind = 'block') AS distrust FROM passed WHERE round = 20 GROUP BY host)
SELECT page_id, s.host, path, rule, coalesce(verdict, CASE WHEN distrust > trust AND distrust >= 75000000 THEN 'block' ELSE 'allow' END) AS verdict
FROM said s LEFT JOIN scores USING (host)
"""
