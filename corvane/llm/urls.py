"""URL filters: rules on hosts and paths, and link-graph propagation for what no rule fits.

The longest rule that fits an address decides. Other pages get their host's verdict: pages that
rules allow make their host a trusted seed, pages that rules block a distrusted one, each by its
share of the host's pages. Trust follows links between hosts (personalised PageRank from the
trusted seeds), distrust follows them backwards from the blocked seeds; a host is blocked if its
distrust exceeds its trust and reaches the threshold.

All of it is DataFrame operations. Up to INLINE rules become one conditional expression without
a shuffle; more are joined by exact host suffix and path prefix. Links are counted per pair of
hosts before they move. Ranks are sums of what arrives in each round; a round moves only what the
last one brought, small rows per host, summed with map-side combining and written to the shared
folder, until no host receives more than TOLERANCE of the rank at which it would be blocked.
Hosts without links pass nothing on. The join of pages with their host's verdict is left to
the planner: a hot host is split, or the hosts are broadcast if they are measured to be few.

Cases: a null address, or one without ://, has empty host and path and no rule; rules of equal
length that fit give block first, then the lesser text; pages without html have no links; hosts
without seeds near them are allowed; repeated pages count and are judged each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
INLINE = 256
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-3, 0.5


def host_of(url: Column) -> Column:
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(after, F.lit("")), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(after, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def _split(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, "/" + path


def _ordered(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(set(rules), key=lambda r: (-len(r[1]), r[0] != "block", r[1]))


def with_rules(pages: DataFrame, rules: list[tuple[str, str]], inline: int = INLINE) -> DataFrame:
    """pages (with host and path) and the columns rule and ruled (allow, block or null)."""
    rules = _ordered(rules)
    if len(rules) <= inline:
        rule = ruled = F.lit(None).cast("string")
        for verdict, text in reversed(rules):
            host, path = _split(text)
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule, ruled = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
        return pages.withColumns({"rule": rule, "ruled": ruled})
    spark = pages.sparkSession
    known = spark.createDataFrame([(*_split(t), t, v, k) for k, (v, t) in enumerate(rules)], "rule_host string, rule_path string, rule string, ruled string, place int")
    lengths = sorted({len(_split(t)[1]) for _, t in rules})
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    distinct = pages.select("host", "path").distinct()
    tried = distinct.select("host", "path", F.explode(suffixes).alias("rule_host"), heads.alias("heads")).select("host", "path", "rule_host", F.explode("heads").alias("rule_path"))
    best = tried.join(known, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.min(F.struct("place", "rule", "ruled")).alias("best"))
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "ruled": F.col("best.ruled")}).drop("best")


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, n): links from pages of one host to another, by addresses that name a host."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1))
    links = F.transform(links, lambda x: F.when(x.startswith("//"), F.concat(F.lit(":"), x)).otherwise(x))
    found = pages.where(F.contains("html", F.lit("//"))).select(host_of(F.col("url")).alias("source"), F.explode(links).alias("link"))
    found = found.select("source", host_of(F.col("link")).alias("target")).where("source <> '' and target <> '' and source <> target")
    return found.groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, seed) along links (source, target, n)."""
    out = links.groupBy("source").agg(F.sum("n").alias("total"))
    shares = common.written(links.join(out, "source").select("source", "target", (F.col("n") / F.col("total")).alias("share")), "shares")
    ranks = arrived = common.written(seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank")).where("rank > 0"), "ranks")
    least = tolerance * THRESHOLD * (1 - damping)
    while not shares.isEmpty():
        moved = shares.join(arrived, shares.source == arrived.host).groupBy(F.col("target").alias("host")).agg((F.sum(F.col("share") * F.col("rank")) * damping).alias("rank"))
        arrived = common.written(moved, "ranks")
        ranks = ranks.union(arrived)
        if arrived.agg(F.coalesce(F.max("rank"), F.lit(0.0))).first()[0] <= least:
            break
    return ranks.groupBy("host").agg(F.sum("rank").alias("rank"))


def host_verdicts(pages: DataFrame, ruled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, blocked) for each host; ruled is pages with host and ruled."""
    share = lambda verdict: (F.count_if(F.col("ruled") == verdict) / F.count("*")).alias(verdict)
    seeds = common.written(ruled.groupBy("host").agg(share("allow"), share("block")), "seeds")
    links = common.written(host_links(pages), "links")
    trust = propagate(seeds.select("host", F.col("allow").alias("seed")), links)
    distrust = propagate(seeds.select("host", F.col("block").alias("seed")), links.select(F.col("target").alias("source"), F.col("source").alias("target"), "n"))
    both = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), "rank"))
    both = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    return both.withColumn("blocked", (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * (1 - DAMPING)))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, inline: int = INLINE) -> DataFrame:
    """Per page: page_id, host, path, rule (or null), verdict (allow or block)."""
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = with_rules(placed, RULES if rules is None else rules, inline)
    hosts = common.written(host_verdicts(pages, ruled).select("host", "blocked"), "hosts")
    verdict = F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow"))
    return ruled.join(hosts, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


#: A round of the recursive part moves what the last one brought, for at most 80 rounds.
ORACLE = r"""
WITH RECURSIVE a AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
rules(verdict, rule, rhost, rpath) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
r AS (SELECT p.page_id, p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled
  FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
seed AS (SELECT host, 0.15 * count(*) FILTER (ruled = 'allow') / count(*) AS trust, 0.15 * count(*) FILTER (ruled = 'block') / count(*) AS distrust FROM r GROUP BY host),
hrefs AS (SELECT host AS source, regexp_extract(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)', 1)), '//([^/?#]*)', 1) AS target FROM p),
links AS (SELECT source, translate(target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target, count(*) AS n FROM hrefs WHERE source <> '' AND target <> '' GROUP BY ALL),
other AS (SELECT * FROM links WHERE source <> target),
edges AS (SELECT 'trust' AS kind, source, target, n / sum(n) OVER (PARTITION BY source) AS share FROM other UNION ALL SELECT 'distrust', target, source, n / sum(n) OVER (PARTITION BY target) FROM other),
arrived AS (SELECT 0 AS k, 'trust' AS kind, host, trust AS rank FROM seed UNION ALL SELECT 0, 'distrust', host, distrust FROM seed
  UNION ALL SELECT k + 1, kind, target, 0.85 * sum(share * rank) FROM arrived JOIN edges USING (kind) WHERE source = host AND k < 80 AND rank > 0 GROUP BY k, kind, target),
h AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM arrived GROUP BY host)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN h.distrust > h.trust AND h.distrust >= 0.075 THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN h USING (host)
"""
