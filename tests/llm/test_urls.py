from plexspark.llm import urls
from plexspark.plans import connected as components


def judged(spark, rows):
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")).collect()
    return {r.page_id: r for r in out}


def page(i, url, html=""):
    return (i, url, html, "clash")


def test_rules_hosts_and_paths(spark):
    got = judged(spark, [
        page(1, "https://a.EXAMPLE.com/en/1?x#y"), page(2, "http://example.com/en/71"), page(3, "http://xexample.com/en/71"), page(4, "ftp://b.net/de/8"), page(5, "http://example.net/de/81"),
        page(6, None), page(7, "no scheme.com/en/1"), page(8, "http://é.org/es/"), page(9, "http://a.org?q=/es/"), page(10, "x://y.com/en/://z.net/de/"), page(11, ""), page(12, "http://com/en/")])
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()} == {
        1: ("a.example.com", "/en/1", "com/en/", "block"), 2: ("example.com", "/en/71", "example.com/en/7", "allow"), 3: ("xexample.com", "/en/71", "com/en/", "block"),
        4: ("b.net", "/de/8", "net/de/", "allow"), 5: ("example.net", "/de/81", "example.net/de/8", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("é.org", "/es/", "org/es/", "block"), 9: ("a.org", "", None, "allow"), 10: ("y.com", "/en/://z.net/de/", "com/en/", "block"), 11: ("", "", None, "allow"), 12: ("com", "/en/", "com/en/", "block"),
    }


def test_decisions_reach_aliases(spark):
    link = lambda u: f'<html><LINK href="{u}" rel="canonical"></html>'
    refresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    got = judged(spark, [
        page(1, "http://a.com/en/1"), page(2, "http://b.info/x", link("http://a.com/en/1.html")), page(3, "http://c.info/", refresh("http://b.info/x/")), page(4, "http://c.info/#top", None),
        page(5, "http://d.info/1", link("/2")), page(6, "http://d.info/2", link("http://a.org/es/9")), page(7, "http://e.info/", link("http://a.org/es/9")), page(8, "http://x.net/de/1", link("http://e.info")),
        page(9, "http://a.org/es/9"), page(10, "http://f.info/z")])
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow"}
    assert len({got[i].component for i in (1, 2, 3, 4)}) == 1 and len({got[i].component for i in (5, 6, 7, 8, 9)}) == 1


def test_redirect_table_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.info/1", None), (1, "http://a.info/1", None), (2, "http://a.org/es/", None)], "page_id long, url string, html string")
    moves = spark.createDataFrame([("https://a.info/1", "http://a.org/es"), (None, "http://a.info/1")], "from_url string, to_url string")
    assert [r.verdict for r in urls.judge(pages, moves).collect()] == ["block"] * 3
    assert urls.judge(pages.limit(0)).count() == 0


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500), (501, 502), (502, 501), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_rules_reach_addresses_that_are_no_pages(spark):
    link = lambda u: f'<html><LINK href="{u}" rel="canonical"></html>'
    refresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    got = judged(spark, [
        page(1, "http://b.info/1", link("http://a.org/es/9")), page(2, "http://b.info/2", refresh("http://a.org/es/")), page(3, "http://b.info/3", link("http://x.net/de/1") + refresh("http://a.org/es/8")),
        page(4, "http://b.info/4", link("http://a.org/es")), page(5, "http://x.com/en/1", link("http://x.net/de/1"))])
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block"}  # 4 is an alias of 2
    pages = spark.createDataFrame([(1, "http://a.info/1", None), (2, "http://a.info/2", None), (3, "http://a.info/3", None)], "page_id long, url string, html string")
    moves = [("http://a.info/1", "http://m.info/1"), ("http://m.info/1", "http://a.org/es/1"), ("http://a.info/2", "http://a.org/es/2"), ("http://a.org/es/2", "http://b.net/de/2"), (None, "http://a.org/es/3"), ("http://a.info/3", "//a.org/es/4")]
    assert {r.page_id: r.verdict for r in urls.judge(pages, spark.createDataFrame(moves, "from_url string, to_url string")).collect()} == {1: "block", 2: "allow", 3: "block"}


def test_relative_links(spark):
    from urllib.parse import urljoin, urlsplit

    bases = ["http://H.info/a/b/c.html", "http://h.info", "http://h.info/a/b/?q=/x/y#z/w", "https://h.info/a"]
    links = ["x.html", "x/y", "./x", "../x", "../../../x/./y/..", "..", ".", "/x", "/x/../y/.", "//K.info/x", "//k.info", "?q=1", "#top", "x?u=http://k.info/z", "http://k.info/x", "http://k.info/x#y", "mailto:a@k.info", "/x/.y/..z"]
    rows = [(n, b, f'<link rel="canonical" href="{u}">', None) for n, (b, u) in enumerate((b, u) for b in bases for u in links)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string").selectExpr("page_id", "url", "html")
    host, path = urls.host_path(df.url)
    got = {r.page_id: r.b for r in df.select("page_id", urls.aliases(df.html, host, path, urls.query_of(df.url))[0]["address"].alias("b")).collect()}

    def want(base, u):
        to = urlsplit(urljoin(base, u))
        return to.netloc.lower() + to.path.removesuffix("/").removesuffix(".html") + f"?{to.query}" * bool(to.query) if to.netloc else None

    assert got == {n: want(b, u) for n, (b, u) in enumerate((b, u) for b in bases for u in links)}
    pages = [page(1, "http://h.info/en/1", link := '<link rel="canonical" href="2.html">'), page(2, "http://h.info/en/3", link), page(3, "http://h.info/n", '<link rel="canonical" href="//a.com/en/1">')]
    out = judged(spark, pages)
    assert out[1].component == out[2].component == "h.info/en/1" and out[3].verdict == "block"


def test_links_equal_brute_force(spark):
    """Components and verdicts over random canonical links, refreshes and redirects, which the SQL's tables don't have."""
    import random

    rng = random.Random(11)
    some = lambda: f"http://{rng.choice(['a.com', 'b.net', 'c.org', 'd.info', 'example.com'])}/{rng.choice(['en', 'de', 'es', 'x'])}/{rng.randrange(60)}"
    rows = [(i, some(), f'<link rel="canonical" href="{some()}">' * (rng.random() < 0.3) + f'<meta http-equiv="refresh" content="0; url={some()}">' * (rng.random() < 0.2)) for i in range(250)]
    moves = [(some(), some()) for _ in range(40)]
    bare = lambda u: u.split("://")[1]

    def rule(u):
        host, path = bare(u).split("/", 1)
        fit = [(len(p), len(h), v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2] if fit else None

    links = moves + [(u, x.split('"')[0]) for _, u, html in rows for x in html.replace("url=", 'href="').split('href="')[1:]]
    every = {u for ends in links for u in ends} | {u for _, u, _ in rows}
    component = {bare(u): bare(u) for u in every}
    for _ in every:
        before = dict(component)
        for a, b in links:
            component[bare(a)] = component[bare(b)] = min(component[bare(a)], component[bare(b)])
        if before == component:
            break
    said = {}
    for u in every:
        said.setdefault(component[bare(u)], set()).add(rule(u))
    want = {i: (rule(u) or ("allow" if "allow" in said[component[bare(u)]] or "block" not in said[component[bare(u)]] else "block"), component[bare(u)]) for i, u, _ in rows}
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(moves, "from_url string, to_url string")).collect()
    assert {r.page_id: (r.verdict, r.component) for r in got} == want and len({c for _, c in want.values()}) < len({u for _, u, _ in rows})


def test_written_forms_of_one_resource(spark):
    same = ["http://a.info/x", "https://WWW.a.info/x.html", "https://m.a.info/x/?utm_source=feed#top", "ftp://a.info/x/index.html?ref=y&fbclid=3", "http://a.info/x?"]
    apart = ["http://a.info/x?id=1", "http://a.info/x?id=2", "http://a.info/x?id=1&page=2", "http://a.info/y", "http://b.info/x", "http://a.info/x.htm", "http://www./x"]
    got = judged(spark, [page(i, u) for i, u in enumerate([*same, *apart, "https://a.info/x/?ref=q&id=1"])])
    assert {got[i].component for i in range(len(same))} == {"a.info/x"}
    assert len({got[i].component for i in range(len(same) + len(apart))}) == 1 + len(apart)
    assert got[len(same) + len(apart)].component == got[len(same)].component == "a.info/x?id=1"


def test_every_link_counts_and_long_pages_are_quick(spark):
    import time

    two = '<link rel="canonical" href="http://q.info/1"><link rel=canonical href=//a.org/es/1><meta http-equiv=refresh content="0; url=http://r.info/">'
    began = time.time()
    got = judged(spark, [page(1, "http://z.info/1", two), page(2, "http://q.info/1"), page(3, "http://r.info"), page(4, "http://l.info/" + "x" * 300_000, "<link rel " * 200_000 + "canonical"), page(5, "http://l.info/2", "<meta " * 200_000 + "refresh")])
    assert time.time() - began < 60
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_sql_follows_links(spark, tmp_path):
    """The SQL of the query agrees with it on tables that have links, which the given ones have not."""
    import random

    import duckdb

    from plexspark.llm.queries import SQL, op5_url_filters

    rng = random.Random(5)
    some = lambda: f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['a.com', 'b.net', 'c.org', 'd.info', 'example.com'])}/{rng.choice(['en', 'de', 'es', 'x'])}/{rng.randrange(60)}{rng.choice(['', '/', '.html', '?p=1', '?ref=2'])}"
    to = lambda: rng.choice([some(), some()[5:], f"/es/{rng.randrange(60)}", f"{rng.randrange(60)}?p=1"])
    rows = [(i, some(), f'<link rel="canonical" href="{to()}">' * (rng.random() < 0.4) + f"<META http-equiv='refresh' content='0; url={to()}'>" * (rng.random() < 0.2)) for i in range(200)] + [(200, None, "x"), (201, "none", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = op5_url_filters(spark, str(tmp_path))
    got = {tuple(r) for r in df.collect()}
    assert got == set(con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['op5_url_filters']})").fetchall())
    assert len({r[6] for r in got}) < len({r[5] for r in got})
