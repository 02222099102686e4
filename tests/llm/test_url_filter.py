import math
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import url_filter as U

RULES = [*U.RULES, ("bad.example", "/", "block"), ("bad.example", "/ok/", "allow"), ("Good.Example", "/", "allow"), ("good.example", "/x", "block"), ("host:80", "/", "block")]
SCHEMA = "page_id long, url string, html string, host string, n long, _tz_row string"


def brute_rule(host, path, rules):
    fits = [(-len(h + p), -len(h), h, p, v) for h, p, v in ((h.lower(), p, v) for h, p, v in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits) if fits else None


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def brute(rows, rules, damping=0.85, rounds=20, least=0.5):
    parsed = [(i, *split(u)) for i, u, _ in rows]
    ruled = [brute_rule(h, p, rules) for _, h, p in parsed]
    pages, said = Counter(), defaultdict(Counter)
    for (_, h, _), r in zip(parsed, ruled):
        if h:
            pages[h] += 1
            said[h][r[4] if r else None] += 1
    weight = Counter()
    for (_, h, _), (_, _, html) in zip(parsed, rows):
        for d in {x.lower() for x in re.findall(U.LINK, html or "")}:
            if h and d != h:
                weight[h, d] += 1
    nodes = set(pages) | {d for _, d in weight}
    for h in nodes:
        parts = h.split(".")
        up = next((u for u in (".".join(parts[i:]) for i in range(1, len(parts))) if u in nodes), None)
        if up is not None:
            weight[h, up] += 1
            weight[up, h] += 1
    scores = {}
    for kind, turn in (("allow", False), ("block", True)):
        edges = [((d, s) if turn else (s, d)) + (w,) for (s, d), w in weight.items()]
        out = Counter()
        for s, _, w in edges:
            out[s] += w
        own = {h: math.floor((1 - damping) * (U.UNIT * said[h][kind] // pages[h] if pages[h] else 0)) for h in nodes}
        now = dict(own)
        for _ in range(rounds):
            come = Counter()
            for s, d, w in edges:
                come[d] += math.floor(damping * now[s] * (w / out[s]))
            now = {h: own[h] + come[h] for h in nodes}
        scores[kind] = now
    verdicts = []
    for (i, h, p), r in zip(parsed, ruled):
        t, d = scores["allow"].get(h, 0), scores["block"].get(h, 0)
        verdicts.append((i, h, p, r[2] + r[3] if r else None, r[4] if r else "block" if d > t and d >= int(least * (1 - damping) * U.UNIT) else "allow", t, d))
    return verdicts


LINKS = "<a href='http://Spam.test/x'>x</a><a href=//spam.test/y>y</a><img src=\"https://cdn.test:8080/a.png\"><a href='/own'>z</a>"
ROWS = [
    (1, "http://a.bad.example/x", ""), (2, "http://a.bad.example/ok/1", ""), (3, "https://bad.example", None), (4, "HTTP://WWW.Good.example/x?y#z", LINKS), (5, "http://good.example/a", "<a href='http://friend.test/'>"),
    (6, None, LINKS), (7, "no host", LINKS), (8, "http:///path", LINKS), (9, "a://b.net/en/", ""), (10, "http://x.example.net/en/1", ""), (11, "http://x.example.net/EN/1", ""), (12, "http://friend.test/?q=http://bad.example/", ""),
    (13, "http://spam.test/1", "<a href='http://a.bad.example/'>b</a>" * 3), (14, "http://spam.test/2", "<a HREF = \"//a.bad.example\">b</a>"), (14, "http://spam.test/2", "<a HREF = \"//a.bad.example\">b</a>"), (15, "http://net/", ""), (16, "http://net", ""), (17, "http://host:80/1", ""),
    (18, "http://é.org/fr/ü", ""), (None, "", ""), (20, "ftp://sub.spam.test/z://q", ""), (21, "://x.com/", "<a href='http://" + "l" * 5000 + "'>"),
]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([*RULES, RULES[0]], "host string, path string, verdict string")


def test_against_brute_force(spark, rules):
    pages = spark.createDataFrame([(*r, "clash", 1, "y") for r in ROWS], SCHEMA)
    out = U.url_filter(pages, rules)
    assert set(out.columns) == {"page_id", "url", "host", "n", "_tz_row", "path", "rule", "verdict", "trust", "distrust"}
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, round(r.trust * U.UNIT), round(r.distrust * U.UNIT)) for r in out.collect()]
    want = brute(ROWS, RULES)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    verdict = {r[0]: r[4] for r in want}
    assert (verdict[13], verdict[12], verdict[6], verdict[16]) == ("block", "allow", "allow", "block")  # half of the pages of host net are blocked


def test_a_hot_host_and_many_links(spark, rules):
    rows = [(i, f"http://hub.test/{i}", f"<a href='http://s{i % 40}.test/'>") for i in range(300)] + [(1000 + i, f"http://s{i}.test/", "<a href='http://bad.example/'>" if i < 5 else "") for i in range(40)] + [(2000, "http://bad.example/", "")]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, round(r.trust * U.UNIT), round(r.distrust * U.UNIT)) for r in U.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()]
    assert sorted(got) == sorted(brute(rows, RULES))


def test_empty_and_native(spark, rules, sf):
    assert U.url_filter(spark.createDataFrame([], SCHEMA), rules).count() == 0
    assert U.url_filter(spark.createDataFrame([(*r, "c", 1, "y") for r in ROWS], SCHEMA), rules.limit(0)).filter("rule is not null or verdict = 'block'").isEmpty()
    plan = U.op13_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
