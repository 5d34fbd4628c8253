import re

from llm_samples import SMALL

from fotolake.llm import op5_url_filter as u


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules):
    fit = [(len(h + s), len(h), h + s, v) for v, h, s in rules if (host == h or host.endswith("." + h)) and path.startswith(s)]
    best = max(fit, default=None, key=lambda r: r[:2])
    return (best[2], best[3]) if best else (None, None)


def brute(rows, rules=u.RULES):
    hosts, links, out = {}, {}, []
    for i, url, html in rows:
        host, path = parse(url)
        rule, v = rule_of(host, path, rules)
        out.append((i, host, path, rule, v))
        if host:
            hosts.setdefault(host, [0, 0, 0])[{"allow": 0, "block": 1, None: 2}[v]] += 1
        for m in re.findall(r"href=[\"']?((?:[a-z]+:)?//[^\"'\s>]*)", html or ""):
            to = parse(m if "://" in m else "x:" + m)[0]
            if host and to and to != host:
                links[host, to] = links.get((host, to), 0) + 1
    rank = []
    for k in (0, 1):
        step = links if k == 0 else {(b, a): n for (a, b), n in links.items()}
        total = {}
        for (a, _), n in step.items():
            total[a] = total.get(a, 0) + n
        start = {h: 0.15 * c[k] for h, c in hosts.items()}
        now = dict(start)
        for _ in range(u.ROUNDS if links else 0):
            new = dict(start)
            for (a, b), n in step.items():
                new[b] = new.get(b, 0) + 0.85 * now.get(a, 0) * n / total[a]
            now = new
        rank.append(now)
    bad = {h for h in hosts if rank[1].get(h, 0) > rank[0].get(h, 0) + 0.15 * hosts[h][2] + 1e-12}
    return sorted(((i, h, p, r, v or ("block" if h in bad else "allow")) for i, h, p, r, v in out), key=str)


PAGES = [
    (1, "http://a.example.com/en/7x", "<a href='http://bad.org/es/1'>"), (2, "https://EXAMPLE.com/en/8", '<a href="http://good.net/de/1">'), (3, "x://com/en/", None), (4, None, "<a href=//q.net>"),
    (5, "no scheme", ""), (6, "http://bad.org/es/2?x", ""), (7, "http://bad.org/es/3#y", ""), (8, "http://bad.org/fr/3", ""), (9, "http://friend.info/a", "<a href=http://bad.org/es/1><a href=http://bad.org/es/2>" * 9),
    (10, "http://good.net/de/1://x", "<a href='//nice.info/'>"), (11, "http://nice.info", ""), (12, "http://example.net/de/8a", ""), (13, "http://x?q", ""), (9, "http://friend.info/a", ""), (None, "http://évil.ORG/es/", "a"),
]


def test_pages(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, host string, RULE int")
    got = u.judge(pages)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(PAGES)
    assert u.judge(pages.limit(0)).count() == 0


def test_bad_company(spark):
    rows = [(i, f"http://bad.org/es/{i}", "") for i in range(40)] + [(100, "http://friend.info/a", "<a href=http://bad.org/es/1>"), (101, "http://neutral.info/a", "")]
    got = {r.page_id: r.verdict for r in u.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[100] == "block" and got[101] == "allow"
    assert sorted(map(tuple, u.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str) == brute(rows)


def test_long_rule_lists(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    monkeypatch.setattr(u, "IN_PLAN", 2)
    assert sorted(map(tuple, u.judge(pages).collect()), key=str) == brute(PAGES)


def test_small_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert sorted(map(tuple, u.judge(pages).collect()), key=str) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])
