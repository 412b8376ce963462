import duckdb

from tests.llm import brute
from wardloom.llm import url_filter as uf
from wardloom.llm.queries import ORACLES

PAGES = "page_id long, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[end:]
    stop = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def rule(url):
    host, path = parts(url)
    best = None
    for verdict, h, p in uf.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and host:
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, verdict)
    return best


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.example.com/en/", "x://example.com/de/",
            "http://b.net/es/1", "http://net/fr/", "http://b.org?q=/a", "http://c.com", "http://É.net/fr/é", "a://b://c.net/es/", "http://a.com#/x", "http://x.net/\nes/"]
    df = spark.createDataFrame([(i, u, None, "k") for i, u in enumerate(urls)], PAGES + ", rule string")
    got = {r.page_id: r for r in uf.judged(df).collect()}
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path) == parts(u), u
        found = rule(u)
        assert got[i].rule == (found and found[0]), u
        if found:
            assert got[i].verdict == found[1]
    assert len(got) == len(urls) and got[0].verdict == "allow"
    assert uf.judged(spark.createDataFrame([], PAGES)).count() == 0


def test_decisions_reach_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://m.site.org/a/?utm_source=x", link.format("https://b.net/es/1")),  # blocked by where it points
        (2, "https://site.org/a", None),  # alias of 1
        (3, "http://other.org/a", None),
        (4, "https://hub.org/1", link.format("https://b.net/fr/2")),
        (5, "https://hub.org/1#top", link.format("http://good.com/")),  # explicit allow goes before block
        (6, "https://chain0.org/", None),
        (6, "https://chain0.org/", None),
    ]
    hops = [(f"https://chain{i}.org/", f"http://chain{i + 1}.org/") for i in range(20)] + [("http://chain20.org/", "https://x.net/es/"), (None, "http://a.org/")]
    got = uf.judged(spark.createDataFrame(rows, PAGES), redirects=spark.createDataFrame(hops, "src string, dst string")).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == [
        (1, None, "block"), (2, None, "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, None, "block"), (6, None, "block")]


LINKS = [
    ('<link rel="canonical" href="https://b.net/es/1">', "https://b.net/es/1"),
    ("<LINK HREF=https://b.net/es/1 REL=canonical>", "https://b.net/es/1"),
    ("<link href='https://b.net/es/1'rel='alternate canonical'/>", "https://b.net/es/1"),
    ("<link rel=stylesheet href=/x.css><link rel=canonical href=/es/1?a=1&amp;b=2>", "http://a.net/es/1?a=1&b=2"),
    ("<link rel=canonical href=//b.net/es/1>", "http://b.net/es/1"),
    ("<link rel=canonical href=c/./d/../e#f>", "http://a.net/x/c/e#f"),
    ("<link rel=canonical href=../../../es/>", "http://a.net/es/"),
    ("<link rel=canonical href=?p=1>", "http://a.net/x/y?p=1"),
    ("<meta content=\"0; URL='https://b.net/es/1'\" http-equiv=Refresh>", "https://b.net/es/1"),
    ('<meta http-equiv="refresh" content="5;url=/es/2">', "http://a.net/es/2"),
    ("<link rel=canonical href=#top>", None),
    ("<link rel=canonical href=mailto:a@b.c>", None),
    ("<link rel=canonical>", None),
    ("<link rel=next data-href=/a href=/b>", None),
    ("<meta name=refresh content='0;url=/b'>", None),
    ("<a rel=canonical href=/b><link " + "x" * 200_000, None),
    (None, None),
]


def test_link_forms(spark):
    """Attributes in any order, with or without quotes, and relative addresses; by Spark and by the SQL beside it."""
    rows = [(i, "http://a.net/x/y?q#z", html) for i, (html, _) in enumerate(LINKS)]
    for row, (_, dst) in zip(rows, LINKS):
        assert [r.dst for r in uf.link_edges(spark.createDataFrame([row], PAGES)).collect()] == ([dst] if dst else []), row[2][:80]
    rows = [(i, f"http://s{i}.org/x/y", html) for i, (html, _) in enumerate(LINKS)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    expected = con.sql(ORACLES["op6_url_filter"]).df().set_index("page_id")["verdict"].to_dict()
    got = {r.page_id: r.verdict for r in uf.judged(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == expected and sorted(i for i, v in got.items() if v == "block") == [0, 1, 2, 4, 8]


def test_components_of_random_graphs(spark):
    import random

    from wardloom.llm.work import components

    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(0, 0), (7, 7)]
    roots = brute.grouped(260, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: roots[n] for e in edges for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
