import re

from timberline.llm.common import Scratch
from timberline.llm.queries import URL_RULES
from timberline.llm.url_trust import LEFT, judge


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path):
    fits = []
    for action, rule in URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://A.Example.ORG/es/1?x",
    "https://example.org/en/12",
    "https://example.org/en/2#/es/",
    "x://shop.com/de/9",
    "x://shop.com/fr",
    "x://shop.com/fr/",
    "no url",
    "",
    None,
    "a://b://c/d",
    "http://org/",
    "http://notorg/",
    "http://x.net?q=/a",
    "http://ÜBER.com/de/",
    "://h\nost.org/a\nb",
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")


def test_rules_and_parts(spark):
    rows = [(k, u, None) for k, u in enumerate(URLS)] * 2
    out = judge(pages(spark, rows), Scratch(spark), URL_RULES).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path = plain(URLS[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict is None or r.verdict == verdict
        assert r.verdict in ("allow", "block")


def test_scores_match_a_plain_walk(spark):
    link = lambda *hosts: "".join(f'<a class=x href="https://{h}/p">t</a>' for h in hosts)
    rows = [
        (1, "http://good.org/", link("friend.net", "FRIEND.net:80", "odd.net")),
        (2, "http://spam.com/de/1", link("odd.net")),
        (3, "http://farm.net/", link("spam.com", "spam.com")),
        (4, "http://friend.net/", link("friend.net")),
        (5, "http://odd.net/", "<a href='/local'>"),
        (6, "http://a.m.farm.net/", None),
        (7, "http://" + "x." * 5000 + "net/", None),
        (8, "http://a..net/", None),
    ]
    out = {r.page_id: r for r in judge(pages(spark, rows), Scratch(spark), URL_RULES).collect()}
    edges = {("good.org", "friend.net"): 2.0, ("good.org", "odd.net"): 1.0, ("spam.com", "odd.net"): 1.0, ("farm.net", "spam.com"): 1.0}
    edges[("good.org", "friend.net")] = 2.0
    edges |= {("m.farm.net", "farm.net"): 1.0, ("farm.net", "m.farm.net"): 1.0}
    edges |= {("a.m.farm.net", "m.farm.net"): 1.0, ("m.farm.net", "a.m.farm.net"): 1.0}

    def walk(edges, seed):
        mass, total = {seed: 0.15}, {seed: 0.15}
        for _ in range(200):
            after = {}
            for (a, b), w in edges.items():
                if a in mass:
                    whole = sum(x for (s, _), x in edges.items() if s == a)
                    after[b] = after.get(b, 0) + 0.85 * mass[a] * w / whole
            mass = after
            for h, x in after.items():
                total[h] = total.get(h, 0) + x
        return total

    trust, distrust = walk(edges, "good.org"), walk({(b, a): w for (a, b), w in edges.items()}, "spam.com")
    for r in out.values():
        assert abs(r.trust - trust.get(r.host, 0)) < LEFT and abs(r.distrust - distrust.get(r.host, 0)) < LEFT
    assert [out[k].verdict for k in range(1, 9)] == ["allow", "block", "block", "allow", "allow", "block", "allow", "allow"]


def test_far_hosts_are_reached(spark):
    """Distrust goes back over a chain of twenty links; rows and columns of no use change nothing."""
    link = lambda k: f'<a href="//h{k}.net/">'
    rows = [(0, "http://spam.com/de/1", None), (1, "http://h1.net/", '<a href="//spam.com/de/">')]
    rows += [(k, f"http://h{k}.net/", link(k - 1)) for k in range(2, 21)]
    out = {r.page_id: r for r in judge(pages(spark, rows), Scratch(spark), URL_RULES, left=1e-9).collect()}
    for k in range(1, 21):
        assert out[k].verdict == "block" and abs(out[k].distrust - 0.15 * 0.85**k) < 1e-9


def test_empty(spark):
    assert judge(pages(spark, []), Scratch(spark), URL_RULES).collect() == []
