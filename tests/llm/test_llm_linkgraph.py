"""Rules and the link graph of hosts against a plain walk over the graph."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from forumlens.llm import linkgraph, queries


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")


def rule_of(host, path, rules):
    fitting = []
    for verdict, place in rules:
        rule_host, slash, rest = place.partition("/")
        if host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rest):
            fitting.append((len(place), len(rule_host), verdict, place))
    return max(fitting)[2:] if fitting else (None, None)


def brute_force(pages, rules, waves=linkgraph.WAVES):
    links = Counter()
    for _, url, html in pages:
        source = parts(url)[0]
        for link in re.findall(linkgraph.LINK, html or ""):
            target = parts(":" + link if link.startswith("//") else link)
            if target[0] and target[0] != source:
                links[(source, *target)] += 1
    known = Counter()
    for _, url, _ in pages:
        known[parts(url)] += 1
    for (_, host, path), times in links.items():
        known[host, path] += times
    seen, seeds = Counter(), {"allow": Counter(), "block": Counter()}
    for (host, path), times in known.items():
        seen[host] += times
        verdict, _ = rule_of(host, path, rules)
        if verdict and host:
            seeds[verdict][host] += times
    edges = Counter()
    for (source, host, _), times in links.items():
        if source:
            edges[source, host] += times
    ranks = {}
    for side in seeds:
        out = defaultdict(dict)
        for (source, host), times in edges.items():
            a, b = (source, host) if side == "allow" else (host, source)
            out[a][b] = times
        wave = {host: n / seen[host] * (1 - linkgraph.DAMPING) for host, n in seeds[side].items()}
        ranks[side] = Counter(wave)
        for _ in range(waves):
            moved = Counter()
            for host, rank in wave.items():
                for target, times in out[host].items():
                    moved[target] += linkgraph.DAMPING * rank * times / sum(out[host].values())
            wave = moved
            ranks[side].update(wave)
    found = []
    for page, url, _ in pages:
        host, path = parts(url)
        verdict, rule = rule_of(host, path, rules)
        trust, distrust = ranks["allow"][host], ranks["block"][host]
        blocked = host and trust + distrust > 0 and round(distrust / (trust + distrust), 9) > 0.5
        found.append((page, host, path, rule, verdict or ("block" if blocked else "allow")))
    return sorted(found, key=repr)


def filtered(spark, pages, rules):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    clashing = ("host path rule verdict page source times side rank rule_host host_rules ruled link fits").split()
    found = linkgraph.filter_urls(frame.select("*", *[F.lit("x").alias(n) for n in clashing]), linkgraph.rules(spark, rules))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted((tuple(row) for row in found.collect()), key=repr)


def page(*targets):
    return "<p>text</p>" + "".join(f'<a class="x" href="{target}">link</a>' for target in targets)


RULES = [("allow", "good.org/"), ("block", "bad.com/"), ("block", "good.org/spam/"), ("allow", "org/a"), ("block", "mixed.net/x")]
GRAPH = [
    (1, "https://good.org/", page("http://near.net/1", "//far.net/", "/own")),
    (2, "https://near.net/", page("https://far.net/a?b", "https://lone.net/")),
    (3, "https://far.net/", page()),
    (4, "http://farm.net/", page("http://bad.com/1", "http://bad.com/2", "http://www.bad.com/")),
    (5, "http://feeder.net/1", page("http://farm.net/", "http://farm.net/2", "http://near.net/")),
    (6, "http://feeder.net/2", page("http://farm.net/")),
    (7, "http://bad.com/1", page("http://victim.net/")),
    (8, "http://victim.net/", page()),
    (9, "http://mixed.net/x/1", page("http://near.net/")),
    (10, "http://mixed.net/y", page()),
    (11, "http://good.org/spam/1", page("http://near.net/")),
    (12, "http://lone.net/z", "<A\nid=1 HREF = //far.net >x</a><a href=ftp://bad.com/>y</a><img src='http://bad.com/'>"),
]


def test_equals_a_walk_over_the_graph(spark):
    expected = brute_force(GRAPH, RULES)
    assert filtered(spark, GRAPH, RULES) == expected
    verdicts = {row[0]: row[4] for row in expected}
    # What links to a blocked host is distrusted, at one remove as well; what a blocked host links to is not.
    assert [verdicts[n] for n in (2, 3, 4, 6, 8)] == ["allow", "allow", "block", "block", "allow"]
    assert verdicts[7] == "block" and verdicts[11] == "block" and verdicts[1] == "allow"


def test_rings_of_hosts(spark):
    pages = [(i, f"http://h{i}.net/", page(f"http://h{(i + 1) % 9}.net/", f"http://h{i * i % 9}.net/")) for i in range(9)]
    pages += [(20, "http://ok.org/", page("http://h4.net/")), (21, "http://h7.net/q", page("http://bad.com/"))]
    assert filtered(spark, pages, RULES) == brute_force(pages, RULES)


def test_odd_urls(spark):
    urls = [
        None, "", "no url", "://", "http://", "http://good.org", "HTTP://WWW.Good.ORG/spam/", "x://good.org?q=/spam/", "a://b://good.org/",
        "http://good.org#/spam/", "http://notgood.org/x", "http://org/a", "http://.org/a", "http://bad.com:80/", "http://ÄÖ.org/abc",
        "http://" + "a." * 20_000 + "good.org/spam/x", "http://good.org/" + "y" * 200_000, "http://a\nb.org/a\nb", "http://bad.com/",
    ]
    pages = [(n, url, None) for n, url in enumerate(urls)] + [(None, "http://bad.com/", ""), (3, "http://bad.com/", "x")]
    pages.append((90, "http://long.net/", "<a " * 50_000 + "href=//bad.com/>" + "<a href" * 50_000 + "<a href=\"" + " " * 100_000))
    assert filtered(spark, pages, RULES) == brute_force(pages, RULES)
    assert filtered(spark, [], RULES) == []
    assert {row[3:] for row in filtered(spark, pages, [])} == {(None, "allow")}


@pytest.mark.parametrize("name, expected", [
    ("https://a.example.org/es/1", ("example.org/es/", "block")), ("https://example.org/en/199", ("example.org/en/1", "block")),
    ("https://b.org/es/1", ("org/", "allow")), ("http://x.com/fr/", ("com/fr/", "allow")), ("http://x.com/de/9?a", ("com/de/", "block")),
    ("http://x.com/en/9", (None, "allow")), ("http://x.net/de/", (None, "allow")), ("http://org", (None, "allow")),
])
def test_rules_of_the_query(spark, name, expected):
    assert filtered(spark, [(1, name, None)], queries.URL_RULES)[0][3:] == expected
