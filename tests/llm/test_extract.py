import time

import numpy as np
import pytest

from netpen.llm import boosting, dom, extract

PARAGRAPHS = [f"Sentence number {i} tells something of the {w}, and then it goes on for a while." for i, w in
              enumerate(["river", "harbour", "mountain", "valley", "market", "school", "garden", "bridge"] * 5)]


@pytest.fixture(scope="module")
def model():
    sample = [f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>{p}</p></article>"
              f"<footer>&copy; us</footer></body></html>" for p in PARAGRAPHS]
    return extract.fit(sample)


def runs(page):
    nodes = dom.Nodes()
    nodes.add(page, {})
    return [t for t in nodes.texts if t]


def test_blocks():
    assert runs("<p>a&amp;b <b>c</b>d<br>e<p>f<div>g<ul><li>h<li>i</ul>j</div>k") == ["a&b cd e", "f", "g", "h", "i", "j", "k"]
    assert runs("<title>t</title><script>var t='</p>';</script><style>p{}</style><!-- x --><p>a  \n\t b</p>") == ["a b"]
    assert runs("<html><head><meta><title>x</title></head><body>y &lt;z&gt; &nosuch; &#233;</body></html>") == ["y <z> &nosuch; é"]
    assert runs("") == [] and runs("<") == ["<"] and runs("plain < text") == ["plain < text"]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table><select><option>no</select>d") == ["a", "b", "c", "d"]
    assert runs("<p>open <a href='>'>quoted</a") == ["open quoted"]


def test_unseen_layouts(model):
    """Held-out accuracy on layouts of another seed and with other texts."""
    other = [f"Another text about {w} with quite a few words, written by nobody in particular, number {i}." for i, w in
             enumerate(["ships", "trees", "songs", "stones"] * 10)]
    make = extract._Layouts(other, ["Start", "Blog", "Contact us"], 1234)
    right = total = exact = 0
    for _ in range(200):
        page = make.page()
        marked = runs(page)
        want = [t[1:] for t in marked if t.startswith(extract.MARK)]
        got = extract.main_texts([page.replace(extract.MARK, "")], model, {})[0].split("\n")
        got = [g for g in got if g]
        exact += got == want
        common = sum(min(got.count(t), want.count(t)) for t in set(want))
        right += 2 * common
        total += len(got) + len(want)
    assert right / total > 0.9 and exact > 100


def test_decoding_is_consistent(model):
    nodes, pick = dom.Nodes(), np.random.default_rng(3)
    make = extract._Layouts(PARAGRAPHS, ["a"], 5)
    for _ in range(20):
        nodes.add(make.page(), {})
    a = nodes.arrays()
    for _ in range(5):
        chosen = dom.choose(a, pick.normal(0, 3, len(a["page"])))
        child = a["parent"] >= 0
        assert not (chosen[child] & ~chosen[a["parent"][child]]).any()


def test_decoding_is_the_likeliest():
    nodes = dom.Nodes()
    nodes.add("<div><p>a</p><p>b</p></div><section>c</section>", {})
    a = nodes.arrays()
    n = len(a["page"])
    pick = np.random.default_rng(1)
    for _ in range(30):
        score = pick.normal(0, 2, n)
        best = max((sum(-np.logaddexp(0, -s if y else s) for s, y in zip(score, labels)), labels)
                   for labels in (tuple(bool(m >> i & 1) for i in range(n)) for m in range(1 << n))
                   if labels[0] and all(not y or labels[p] for y, p in zip(labels[1:], a["parent"][1:])))
        assert tuple(dom.choose(a, score)) == best[1]


def test_trees_learn():
    pick = np.random.default_rng(0)
    x = pick.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = boosting.train(x[:2000], y[:2000])
    assert ((boosting.predict(model, x[2000:]) > 0) == y[2000:]).mean() > 0.97


def test_tables(llm, model):
    main = PARAGRAPHS[0]
    page = (f'<html><head><title>x</title></head><body><nav><a href="/">Home</a></nav><main><h1>Head &amp; line</h1><p>{main}</p>'
            f'</main><div class="comments"><p>{PARAGRAPHS[1]}</p></div><footer>{PARAGRAPHS[2]}</footer></body></html>')
    rows = [(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 2), (3, "v", "", 3), (None, "w", "<p>" * 2000, 4)]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string, row int")
    got = sorted([(r.page_id, r.url, r.row, r.text) for r in extract.extract(pages, model).collect()], key=repr)
    want = f"Head & line\n{main}"
    assert got == sorted([(1, "u", 1, want), (1, "u", 1, want), (2, None, 2, ""), (3, "v", 3, ""), (None, "w", 4, "")], key=repr)
    assert extract.extract(pages.limit(0), model).count() == 0
    again = extract.train(pages, layouts=60)
    assert extract.extract(pages, again).count() == 5


def test_long_pages_take_time_in_proportion(model):
    """Deep nesting, tags without ends and quotes without ends, each about a megabyte."""
    deep = "<div>" * 100_000 + "<p>Some words, deep down in here.</p>" + "</div>" * 100_000
    begun = time.monotonic()
    for page in (deep, "<ul>" * 100_000 + "<li>x" * 100_000, "<a " * 350_000, '<a "' * 250_001, "<p" * 500_000,
                 "<!--" * 250_000, "<script>" * 120_000, "<b><p>x</b>" * 90_000):
        extract.main_texts([page], model, {})
    assert time.monotonic() - begun < 120


def test_lists_close_their_items():
    assert runs("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    nodes = dom.Nodes()
    nodes.add("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>x<table><tr><td>y</table><td>z", {})
    parents = {t: nodes.parent[nodes.parent[i]] for i, t in enumerate(nodes.texts) if t}
    assert parents["a"] == parents["c"] != parents["b"] and parents["x"] == parents["z"] != parents["y"]
    assert runs("<noscript>a</noscript><math><mi>b</mi></math><object><p>c</p></object>") == ["ab", "c"]
