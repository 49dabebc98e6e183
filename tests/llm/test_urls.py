import re

from tracewell.llm import urls as U
from tracewell.llm.components import components


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fit = [(len(h) + len(p), h + p, a) for a, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, action = max(fit) if fit else (0, None, None)
    return host, path, rule, action


URLS = [None, "", "x", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/1?x=/fr/#y", "http://example.com/en", "http://m.example.com/en/2", "http://net/es/", "ftp://a.net/fr/#", "http://xnet/es/", "a://b://c.net/es/x", "http://com?/", "http://É.com/\n/x", "http://a.org/en/"]


def test_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, html string")
    for r in U.filter_urls(pages).collect():
        host, path, rule, action = brute((URLS + URLS[:3])[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, action or "allow")


def test_blocks_spread_to_aliases_and_allow_wins(spark):
    link = '<head><link rel="canonical" href="{}"></head>'
    rows = [
        (1, "http://a.org/1", link.format("http://b.org/1")), (2, "http://b.org/1", '<meta http-equiv="refresh" content="0; url=http://x.net/es/1">'), (3, "http://c.org/1", "<p>none</p>"),
        (4, "http://d.org/1#top", link.format("http://y.net/es/2")), (5, "http://e.org/1", link.format("http://D.org/1")), (6, "http://z.com/q", link.format("http://d.org/1")), (7, "http://f.org/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://f.org/", "http://a.org/1"), (None, "http://q.org")], "source string, target string")
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(pages, redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block"}


def test_components(spark):
    import random

    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_empty(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_links_of_all_forms_against_brute_force_components(spark):
    """Absolute, protocol-relative, rooted, relative, escaped, chained and cyclic links of 500 pages."""
    import random
    from urllib.parse import urljoin, urlsplit

    r = random.Random(12)
    hosts = ["a.org", "B.org", "e.org", "f.org", "c.net", "www.example.com", "m.net"]
    url = lambda: f"http://{r.choice(hosts)}/{r.choice(('en', 'es', 'fr', 'x'))}/{r.randint(1, 40)}/p{r.randint(1, 3)}"
    pages = []
    for i in range(500):
        here, kind = url(), r.randrange(9)
        there = url()
        path = there.split("/", 3)[3]
        to = (there, "//" + there.split("//")[1], "/" + path, f"p{r.randint(1, 3)}", f"../{r.randint(1, 30)}/p1", "?a=1&amp;b=2", "./", "#top", "mailto:x@y.org")[kind]
        q = r.choice("\"'")
        html = r.choice((f"<link rel={q}canonical{q} href={q}{to}{q}>", f"<meta http-equiv=refresh content={q}0; url={to}{q}>", f"<LINK href={q}{to}{q} REL=canonical />"))
        pages.append((i, here, html if r.random() < 0.5 else None, to))
    norm = lambda u: urlsplit(u)._replace(netloc=urlsplit(u).netloc.lower(), fragment="").geturl()
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for _, here, html, to in pages:
        if html and not to.startswith("mailto:") and not to.startswith("#"):
            a, b = find(norm(here)), find(norm(urljoin(here, to.replace("&amp;", "&"))))
            root[max(a, b)] = min(a, b)
    said: dict = {}
    for n in root:
        said.setdefault(find(n), set()).add(brute(n)[3])
    got = {x["page_id"]: x for x in U.filter_urls(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(3)).collect()}
    differs = 0
    for i, here, _, _ in pages:
        own, n = brute(here)[3], norm(here)
        votes = said.get(find(n), set()) if n in root else set()
        want = own or ("allow" if "allow" in votes else "block" if "block" in votes else "allow")
        assert (got[i]["verdict"], got[i]["alias"]) == (want, find(n) if n in root and len([x for x in root if find(x) == find(n)]) > 1 else None), (pages[i], want)
        differs += own is None and want == "block"
    assert differs >= 5
