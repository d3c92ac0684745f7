import math
import random

import duckdb

from scriptorium.llm import link_trust, queries


def test_places_and_rules(spark):
    urls = [
        (1, "HTTP://WWW.Example.COM/en/a?b://c", "<p>"), (2, "https://x.example.com/en/", None), (3, "https://x.example.com/EN/", ""), (4, "http://example.net/fr/x#y", ""),
        (5, "no scheme /en/", ""), (6, None, None), (7, "http://com", ""), (8, "http://a.com/?q", ""), (9, "", ""), (10, "://net/es/", ""), (11, "http://notnet/es/", ""), (1, "HTTP://WWW.Example.COM/en/a?b://c", "<p>"),
    ]
    pages = spark.createDataFrame([(*u, "mine", 1) for u in urls], "page_id long, url string, html string, rule string, _host int")
    out = link_trust.judge(pages, queries.URL_RULES)
    assert out.columns == ["page_id", "url", "html", "_host", "host", "path", "rule", "verdict", "trust", "distrust"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == 12
    assert got == {
        1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("x.example.com", "/en/", "example.com/en/", "block"), 3: ("x.example.com", "/EN/", "com/", "allow"),
        4: ("example.net", "/fr/x", "net/fr/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("com", "", None, "allow"), 8: ("a.com", "/", "com/", "allow"),
        9: ("", "", None, "allow"), 10: ("net", "/es/", "net/es/", "block"), 11: ("notnet", "/es/", None, "allow"),
    }
    assert link_trust.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in link_trust.judge(pages, []).collect()} == {"allow"}


def _pages(seed=3):
    """Pages of 40 hosts with links among them, one host with a third of the rows."""
    rng = random.Random(seed)
    hosts = [f"h{k}.{rng.choice(['com', 'net', 'org', 'info'])}" for k in range(40)]
    rows = []
    for k in range(900):
        host = hosts[0] if k % 3 == 0 else rng.choice(hosts)
        anchors = [rng.choice([f'<a href="http://{t}/x">', f"<A class=b HREF='//{t.upper()}/y?z'>", f"<a href={'https'}://{t}#q>", '<a href="/own">', f'<a href="http://{host}/self">']) for t in rng.choices(hosts, k=rng.randrange(4))]
        rows.append((k, f"https://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{k}", None if k % 50 == 0 else " ".join(anchors) + '<img src="http://picture.net/a">'))
    return rows


def test_spread_by_plain_python_and_sql(spark, tmp_path):
    rows = _pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op11_link_trust(spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    sql = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.ORACLES['op11_link_trust']})").fetchall()
    assert got == sorted(sql, key=str)
    edges = {(r.src, r.dst): r.n for r in link_trust.links(pages).collect()}
    assert len(edges) > 100 and all(a != b for a, b in edges)
    seeds = {}
    for r in got:
        seeds.setdefault(r[1], []).append(r[4] if r[3] else None)
    unit = link_trust.UNIT
    for side, what in ((5, "allow"), (6, "block")):
        start = {h: math.floor(unit * (v.count(what) / len(v))) for h, v in seeds.items()}
        flow = {(a, b): n for (a, b), n in edges.items()} if side == 5 else {(b, a): n for (a, b), n in edges.items()}
        total = {}
        for (a, _), n in flow.items():
            total[a] = total.get(a, 0) + n
        now = dict(start)
        for _ in range(link_trust.ROUNDS):
            after = dict(start)
            for (a, b), n in flow.items():
                after[b] = after.get(b, 0) + math.floor(link_trust.DAMPING * now.get(a, 0) * (n / total[a]))
            now = after
        assert all(now.get(r[1], 0) == r[side] for r in got)
    free = [r for r in got if r[3] is None]
    assert {r[4] for r in free} == {"allow", "block"}  # hosts that no rule names are judged by their links


def test_distrust_goes_against_links(spark):
    pages = [(1, "http://bad.net/es/", ""), (2, "http://farm.org/", '<a href="http://bad.net/es/">'), (3, "http://good.com/", '<a href="http://friend.org/">'), (4, "http://friend.org/", ""), (5, "http://victim.org/", ""), (6, "http://bad.net/es/2", '<a href="http://victim.org/">')]
    out = {r.host: r for r in link_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert out["farm.org"].verdict == "block" and out["victim.org"].verdict == "allow" and out["victim.org"].distrust == 0
    assert out["friend.org"].verdict == "allow" and out["friend.org"].trust > 0
