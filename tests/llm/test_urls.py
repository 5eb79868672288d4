"""URL verdicts against a plain propagation and against the SQL, on pages whose links cross hosts."""

import random
import re

import duckdb
import pytest

from cairn.llm.oracles import ORACLES
from cairn.llm.queries import URL_RULES
from cairn.llm.urls import Propagation, host_and_path, judge, rule_table

SCHEMA = "page_id long, url string, html string"


def plain_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def plain_rule(host, path):
    fitting = [(len(h + p), len(h), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting)[2:] if fitting else (None, None)


def plain(rows, how=Propagation()):
    pages = [(i, *plain_host(u), h or "") for i, u, h in rows]
    verdicts = [plain_rule(host, path) for _, host, path, _ in pages]
    edges, counts = {}, {}
    for (_, host, _, html), (_, verdict) in zip(pages, verdicts):
        if not host:
            continue
        count = counts.setdefault(host, {"allow": 0, "block": 0, None: 0})
        count[verdict] += 1
        targets = {plain_host("x:" + m if m.startswith("//") else m)[0] for m in re.findall(r'href="((?:https?:)?//[^"]*)"', html)}
        for other in targets - {host, ""}:
            edges[host, other] = edges.get((host, other), 0) + 1
    ranks = {}
    for kind, pairs in (("allow", edges), ("block", {(b, a): n for (a, b), n in edges.items()})):
        seeds = {h: c[kind] * 2**30 // sum(c.values()) for h, c in counts.items() if c[kind]}
        total = {}
        for (a, _), n in pairs.items():
            total[a] = total.get(a, 0) + n
        rank = dict(seeds)
        for _ in range(how.rounds):
            moved = dict(seeds)
            for (a, b), n in pairs.items():
                moved[b] = moved.get(b, 0) + int(rank.get(a, 0) * how.damping * (n / total[a]))
            rank = moved
        ranks[kind] = rank
    found = []
    for (page, host, path, _), (rule, verdict) in zip(pages, verdicts):
        trust, distrust = ranks["allow"].get(host, 0), ranks["block"].get(host, 0)
        bad = distrust > trust and distrust >= how.threshold * 2**30
        found.append((page, host, path, rule, verdict or ("block" if bad else "allow")))
    return sorted(found, key=repr)


def got(spark, rows, **how):
    return sorted((tuple(r) for r in judge(spark.createDataFrame(rows, SCHEMA), rule_table(spark, URL_RULES), **how).collect()), key=repr)


def by_sql(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    result = db.sql(ORACLES["op11_link_graph_filter"])
    order = [result.columns.index(c) for c in ("page_id", "host", "path", "rule", "verdict")]
    return sorted((tuple(r[k] for k in order) for r in result.fetchall()), key=repr)


def random_pages(seed, n=150):
    rng = random.Random(seed)
    hosts = [f"{rng.choice(['', 'www.', 'Blog.'])}h{k}.{rng.choice(['example.com', 'example.net', 'org', 'de', 'info'])}" for k in range(25)]
    rows = []
    for k in range(n):
        host = hosts[0] if rng.random() < 0.3 else rng.choice(hosts)
        links = "".join(f'<p><a class="x" href="{rng.choice(["http:", "HTTPS:", "", "/page"])}//{rng.choice(hosts)}/q?u=http://no.net">t</a>' for _ in range(rng.randrange(3)))
        links = links.replace("HTTPS:", "https:").replace("/page//", "/page/")
        rows.append((k, f"http://{host}{rng.choice(['/en/', '/de/x', '/fr/', '/', '', '?a=/en/'])}", links))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_propagation_and_sql(spark, seed):
    rows = random_pages(seed)
    want = plain(rows)
    assert got(spark, rows) == want == by_sql(rows)
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}  # the graph decides both ways


def test_distrust_runs_against_links_and_trust_along_them(spark):
    link = lambda host: f'<a href="http://{host}/">x</a>'
    rows = [
        (1, "http://spam.net/", link("victim.info")),
        (2, "http://fan.info/", link("spam.net")),
        (3, "http://victim.info/", ""),
        (4, "http://shop.info/", link("spam.net") + link("victim.info") + link("fine.info")),
        (5, "http://good.org/fr/", link("shop.info") + link("fine.info")),
        (6, "http://good.org/fr/", link("shop.info")),
    ]
    verdicts = {r[0]: r[4] for r in got(spark, rows)}
    # Two hosts link to spam.net, so each gets half of its distrust; shop.info is trusted more than that.
    assert verdicts == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}
    assert {r[0]: r[4] for r in got(spark, rows, how=Propagation(threshold=0.4))}[2] == "block"
    assert got(spark, rows, how=Propagation(threshold=0.4)) == plain(rows, Propagation(threshold=0.4))


def test_awkward_rows(spark):
    rows = [
        (1, None, None), (None, "", ""), (2, "no scheme", "<a href=x>"), (2, "no scheme", "<a href=x>"), (3, "://", "<a " * 200_000),
        (4, "http://", "<a href"), (5, "http://" + "a." * 50_000 + "net/", "x" * 100_000), (6, "HTTPS://ÄB.ORG/fr/ü?x=://y", "<a href='//'>"),
        (7, "http://net", None), (8, "http://net/", None), (9, "http://xnet/", None), (10, "http://user@a.net:80/", None),
    ]
    assert got(spark, rows) == plain(rows)
    assert judge(spark.createDataFrame([], SCHEMA), rule_table(spark, URL_RULES)).collect() == []
    from pyspark.sql import functions as F

    clash = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("host", "path", "rule", "verdict", "bad", "page", "near", "src")))
    assert sorted((tuple(r) for r in judge(clash, rule_table(spark, URL_RULES)).collect()), key=repr) == plain(rows)


def test_many_rules_and_ties(spark):
    rules = [("b.net", "/", "block"), ("net", "/a/", "allow"), ("a.b.net", "", "allow"), ("c", "/", "block")]
    pages = spark.createDataFrame([(1, "http://b.net/a/", ""), (2, "http://a.b.net", ""), (3, "http://x.y.z.c/", "")], SCHEMA)
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge(pages, rule_table(spark, rules)).collect()}
    assert found == {1: ("b.net/", "block"), 2: ("a.b.net", "allow"), 3: ("c/", "block")}


def test_host_and_path(spark):
    urls = ["a://B.c/d?e", "http://x?y/z", "http://x#/z", "x", None, "http:///p", "a\nb://h/p\nq#r"]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [tuple(r) for r in frame.select(*host_and_path(frame["u"])).collect()] == [plain_host(u) for u in urls]
