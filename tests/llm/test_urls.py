import pytest

from netpen.llm import urls


def link(*targets):
    return "".join(f'<p><a class="x" href="{t}">x</a>' for t in targets)


PAGES = [
    (1, "http://Spam.NET/a?b#c", link("http://bad.example.com/x", "/local", "//far.example.com/y")),
    (2, "https://farm.example.com/de/1", link("http://spam.net/")),
    (3, "https://good.example.org/fr/1", link("https://friend.example.com/z", "HTTP://FRIEND.example.com/q")),
    (4, "https://friend.example.com/en/1", link("https://third.example.com/")),
    (5, "https://helper.example.com/en/1", link("http://spam.net/p", "http://spam.net/q")),
    (6, "https://third.example.com/", None), (7, "no scheme", ""), (8, None, link("http://spam.net/")),
    (9, "ftp://example.net/en/", ""), (10, "http://xexample.net/en/1", ""), (11, "http://a.org/fr", ""),
    (12, "http://a.org/fr/?x", ""), (13, "x://y://z/w", ""), (14, "http://net", ""), (15, "://h/p", ""),
    (1, "http://Spam.NET/a?b#c", "repeated"),
]


def brute_scores(pages, rules):
    """PageRank as dense loops over dictionaries."""
    edges = {("spam.net", "bad.example.com"): 1, ("spam.net", "far.example.com"): 1, ("farm.example.com", "spam.net"): 1,
             ("good.example.org", "friend.example.com"): 2, ("friend.example.com", "third.example.com"): 1,
             ("helper.example.com", "spam.net"): 2}
    seeds = {"trust": {"good.example.org", "example.net", "a.org"},
             "distrust": {"spam.net", "farm.example.com", "xexample.net"}}
    out = {}
    for kind, chosen in seeds.items():
        e = edges if kind == "trust" else {(b, a): n for (a, b), n in edges.items()}
        total = {}
        for (a, _), n in e.items():
            total[a] = total.get(a, 0) + n
        start = {h: 1 / len(chosen) for h in chosen}
        score = dict(start)
        for _ in range(300):
            new = {}
            for (a, b), n in e.items():
                if a in score:
                    new[b] = new.get(b, 0) + urls.DAMPING * score[a] * n / total[a]
            back = 1 - sum(new.values())
            for h, s in start.items():
                new[h] = new.get(h, 0) + s * back
            score = new
        for h, s in score.items():
            out.setdefault(h, {"trust": 0.0, "distrust": 0.0})[kind] = s * len(chosen)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_verdicts(llm):
    got = sorted(map(tuple, urls.judge_urls(table(llm, PAGES)).collect()), key=repr)
    want = {
        1: ("spam.net", "/a", "net/", "block"), 2: ("farm.example.com", "/de/1", "example.com/de/", "block"),
        3: ("good.example.org", "/fr/1", "org/fr/", "allow"), 4: ("friend.example.com", "/en/1", None, "allow"),
        5: ("helper.example.com", "/en/1", None, "block"), 6: ("third.example.com", "/", None, "allow"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("example.net", "/en/", "example.net/en/", "allow"),
        10: ("xexample.net", "/en/1", "net/", "block"), 11: ("a.org", "/fr", None, "allow"),
        12: ("a.org", "/fr/", "org/fr/", "allow"), 13: ("y:", "//z/w", None, "allow"), 14: ("net", "", None, "allow"),
        15: ("h", "/p", None, "allow")}
    assert got == sorted([(i, *want[i]) for i, _, _ in PAGES], key=repr)


def test_propagation(llm):
    pages = table(llm, PAGES)
    edges = urls.host_edges(pages)
    seeds = llm.createDataFrame(
        [("good.example.org", "trust"), ("example.net", "trust"), ("a.org", "trust"), ("spam.net", "distrust"),
         ("farm.example.com", "distrust"), ("xexample.net", "distrust")], "host string, kind string")
    got = {r.host: r for r in urls.propagate(edges, seeds).collect()}
    want = brute_scores(PAGES, urls.RULES)
    assert set(got) == set(want)
    for host, score in want.items():
        assert got[host].trust == pytest.approx(score["trust"], abs=1e-5)
        assert got[host].distrust == pytest.approx(score["distrust"], abs=1e-5)


def test_no_pages_and_no_links(llm):
    assert urls.judge_urls(table(llm, [])).count() == 0
    assert [tuple(r) for r in urls.judge_urls(table(llm, [(1, "http://a.example.com/x", None)])).collect()] == [
        (1, "a.example.com", "/x", None, "allow")]


def test_a_long_chain_is_walked_to_its_end(llm):
    """Twenty hosts, each linking to the next, the last to a blocked one; a ring that never settles exactly."""
    hosts = [f"h{i}.example.com" for i in range(20)]
    pages = [(i, f"https://{h}/", link(f"https://{n}/")) for i, (h, n) in enumerate(zip(hosts, [*hosts[1:], "spam.net"]))]
    pages += [(30, "https://spam.net/", ""), (31, "https://free.example.com/", link("https://h0.other.com/"))]
    got = {r.page_id: r.verdict for r in urls.judge_urls(table(llm, pages)).collect()}
    assert got == {**{i: "block" for i in range(20)}, 30: "block", 31: "allow"}


def test_many_seeds_do_not_hide_a_host(llm):
    """A host with one link in ten thousand to a blocked one, among very many blocked ones."""
    edges = llm.createDataFrame([("weak.example.com", "b0", 1), ("other.example.com", "b0", 9999)], "src string, dst string, links long")
    seeds = llm.range(100_000).selectExpr("concat('b', id) as host", "'distrust' as kind")
    got = {r.host: r.distrust for r in urls.propagate(edges, seeds).where("host like '%.com'").collect()}
    assert got["weak.example.com"] > urls.TOLERANCE and got["weak.example.com"] < 1e-3


def test_links_in_time(llm):
    long = "<a " * 350_000 + '<A class="x" HREF = "https://b.example.com/x">' + "<a href=" * 100_000
    rows = table(llm, [(1, "https://a.example.com/", long), (2, "https://a.example.com/", "<abbr href='//c.example.com/'>")])
    assert [tuple(r) for r in urls.host_edges(rows).collect()] == [("a.example.com", "b.example.com", 1)]
