"""URL filters: rules for hosts and paths, and for what no rule judges, trust and distrust that spread over links.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they block are distrusted ones. Trust follows the
links from a host to the hosts it links to, distrust runs against them, from a host to those that link to it. Both are
personalised PageRank, summed as a series of waves. A host is blocked if its distrust makes up more than a share of the two.
Everything is expressions and joins; no Python runs on the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumlens.sources.snapshots import materialize

ALLOW, BLOCK = "allow", "block"
# What a wave passes on, how many waves there are at most, and the share of distrust from which a host is blocked.
DAMPING, WAVES, THRESHOLD = 0.85, 30, 0.5
# Shares are compared at this many decimals, so that sums of another order judge alike. A smaller wave is the last.
_DECIMALS, _NOTHING = 9, 1e-12

# Host and path of a URL, and links of a page that name a host.
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)<a(?:rea)?\s[^<>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s<>]+)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark or number sign, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What stands after the host up to a question mark or number sign."""
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def rules(spark: SparkSession, listed: list[tuple[str, str]]) -> DataFrame:
    """``rule_host, rule_path, rule_verdict`` of rules written as (verdict, host and path)."""
    parts = [(verdict, *place.partition("/")) for verdict, place in listed]
    rows = [
        F.struct(
            F.lit(host).alias("rule_host"), F.lit(slash + path).alias("rule_path"), F.lit(verdict).alias("rule_verdict")
        )
        for verdict, host, slash, path in parts
    ]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else _no_rules(spark)


def _no_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rule_host string, rule_path string, rule_verdict string")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, times`` and the ``source`` host of links: how many pages of the source link there. A link within its
    own host names no host as a rule and tells nothing about it; one that does is left out as well."""
    named = F.transform(
        F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)),
        lambda link: F.when(F.startswith(link, F.lit("//")), F.concat(F.lit(":"), link)).otherwise(link),
    )
    # Few pages name other hosts; the others need no search.
    found = pages.where(F.col(html).contains("//")).select(host_of(F.col(url)).alias("source"), F.explode(named).alias("link"))
    found = found.select("source", host_of(F.col("link")).alias("host"), path_of(F.col("link")).alias("path"))
    found = found.where((F.col("host") != "") & (F.col("host") != F.col("source")))
    return found.groupBy("source", "host", "path").agg(F.count("*").alias("times"))


def rules_of_hosts(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """``host, host_rules`` of hosts that rules fit: those of the host and of all domains above it, longest first.

    A host takes part with as many domains above it as the longest rule host has labels. Hosts are few against pages, and
    a host's rules are as many as the rules that name it.
    """
    labels = F.split("host", r"\.")
    most = known.agg(F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0))).first()[0]
    counts = F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(most)))
    above = F.transform(counts, lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), "."))
    if not most:
        return hosts.select("host", F.array().cast(_RULES).alias("host_rules")).limit(0)
    named = hosts.where(F.col("host") != "").select("host", labels.alias("labels"))
    named = named.select("host", F.explode(above).alias("rule_host")).join(known, "rule_host")
    rule = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        F.col("rule_verdict").alias("verdict"), F.col("rule_path").alias("path"), F.col("rule_host").alias("domain"),
    )
    return named.groupBy("host").agg(F.sort_array(F.collect_set(rule), asc=False).alias("host_rules"))


_RULES = "array<struct<size:int,host_size:int,verdict:string,path:string,domain:string>>"


def judged(urls: DataFrame, host_rules: DataFrame) -> DataFrame:
    """``urls`` (``host``, ``path``) with ``rule`` and ``ruled``, its verdict: the longest rule that fits; of equally long
    ones that of the longer host, then a blocking one. NULL where none does."""
    path = F.col("path")
    fitting = F.filter("host_rules", lambda rule: F.startswith(path, rule["path"]))
    found = urls.join(host_rules, "host", "left").withColumn("fits", F.get(fitting, F.lit(0))).drop("host_rules")
    return found.select(
        *urls.columns, F.concat("fits.domain", "fits.path").alias("rule"), F.col("fits.verdict").alias("ruled")
    )


def seeds(urls: DataFrame) -> DataFrame:
    """``side, host, rank`` of hosts with judged URLs (``host, ruled, times``): the share of them that rules allow, on the
    side of trust, and the share that they block, on the side of distrust."""
    counted = urls.where(F.col("host") != "").groupBy("host").agg(
        F.sum("times").alias("all"),
        *[F.sum(F.when(F.col("ruled") == side, F.col("times")).otherwise(0)).alias(side) for side in (ALLOW, BLOCK)],
    )
    shares = F.array(*[F.struct(F.lit(side).alias("side"), (F.col(side) / F.col("all")).alias("rank")) for side in (ALLOW, BLOCK)])
    return counted.select("host", F.inline(shares)).where(F.col("rank") > 0).select("side", "host", "rank")


def arcs(edges: DataFrame) -> DataFrame:
    """``side, origin, target, share`` from ``source, host, times``: a host passes trust on to the hosts it links to, and
    distrust to those that link to it, in proportion to the links."""
    forward = edges.select(F.lit(ALLOW).alias("side"), F.col("source").alias("origin"), F.col("host").alias("target"), "times")
    back = edges.select(F.lit(BLOCK).alias("side"), F.col("host").alias("origin"), F.col("source").alias("target"), "times")
    both = forward.unionByName(back)
    out = both.groupBy("side", "origin").agg(F.sum("times").alias("out"))
    return both.join(out, ["side", "origin"]).select("side", "origin", "target", (F.col("times") / F.col("out")).alias("share"))


def spread(seeded: DataFrame, passed: DataFrame, waves: int = WAVES, damping: float = DAMPING) -> DataFrame:
    """``side, host, rank``: what reaches every host from the seeds over arcs, personalised PageRank but for one factor.

    The rank is the sum over all walks from a seed, each step worth ``damping`` times its share. The walks of one length
    make a wave, which is a join and a sum, written before the next; waves end when nothing passes any more. What is left
    out after the last wave is at most ``damping ** (waves + 1)`` of the seeds' ranks. Walks end at hosts without arcs, so
    ranks are those of a walker that returns to the seeds from there, but for one factor on all hosts.
    """
    wave = materialize(seeded.withColumn("rank", F.col("rank") * (1 - damping)))
    all_waves = [wave]
    passed = materialize(passed)
    for _ in range(waves):
        moved = passed.join(wave.withColumnRenamed("host", "origin"), ["side", "origin"])
        moved = moved.groupBy("side", F.col("target").alias("host")).agg(F.sum(F.col("rank") * F.col("share") * damping).alias("rank"))
        wave = materialize(moved)
        if (wave.agg(F.max("rank")).first()[0] or 0.0) < _NOTHING:
            break
        all_waves.append(wave)
    return reduce(DataFrame.unionByName, all_waves).groupBy("side", "host").agg(F.sum("rank").alias("rank"))


def verdicts(ranks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``host, trust, distrust, verdict`` of every host that trust or distrust reaches."""
    by_side = [F.coalesce(F.sum(F.when(F.col("side") == side, F.col("rank"))), F.lit(0.0)) for side in (ALLOW, BLOCK)]
    found = ranks.groupBy("host").agg(by_side[0].alias("trust"), by_side[1].alias("distrust"))
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), _DECIMALS)
    return found.withColumn("verdict", F.when(share > threshold, BLOCK).otherwise(ALLOW))


def filter_urls(
    pages: DataFrame, known: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD
) -> DataFrame:
    """Every row as ``key, host, path, rule, verdict``.

    ``known`` are rules as :func:`rules` gives them. A rule fits its host and all hosts below it if the path begins with
    its path; its verdict counts, the longest rule's if several fit. Without a rule the verdict is that of the host, by the
    share of distrust among trust and distrust; hosts that neither reaches are allowed, as are URLs without a host. NULL
    URLs have empty hosts and paths; NULL pages have no links. Repeated rows are judged alike, a NULL key stays NULL, and
    other columns are not carried. No rules allow every page.
    """
    urls = pages.select(F.col(key).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    linked = materialize(links(pages, url, html))
    hosts = urls.select("host").union(linked.select("host")).distinct()
    host_rules = materialize(rules_of_hosts(hosts, known))
    own = materialize(judged(urls, host_rules))
    once = own.select("host", "ruled", F.lit(1).cast("long").alias("times"))
    seeded = seeds(once.unionByName(judged(linked, host_rules).select("host", "ruled", "times")))
    edges = linked.where(F.col("source") != "").groupBy("source", "host").agg(F.sum("times").alias("times"))
    found = materialize(verdicts(spread(seeded, arcs(edges)), threshold))
    by_host = found.select("host", F.col("verdict").alias("host_verdict"))
    return own.join(by_host, "host", "left").select(
        F.col("page").alias(key), "host", "path", "rule", F.coalesce("ruled", "host_verdict", F.lit(ALLOW)).alias("verdict")
    )
