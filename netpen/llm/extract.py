"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

The model says of each node whether its subtree holds main text. It is trained on layouts with known
labels, built from the texts of a bounded sample of the pages, and on those sample pages themselves as
far as their own markup (article, main) labels them. The decoding picks the likeliest labelling in
which nothing under a rejected node is kept.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from netpen.llm import boosting, dom

SAMPLE_PAGES = 150   # pages that lend their texts to training; with the next, the bound of what the driver gathers
SAMPLE_CHARS = 20_000  # training takes pages of up to so many characters, whole; extraction reads all pages
LAYOUTS = 400        # training layouts
SEED = 7
MARK = "\ue000"    # starts a run of main text in a training layout
BATCH_PAGES = 200
BATCH_CHARS = 4_000_000

_CONTENT_BOXES = ["<article>", '<article class="post">', "<main>", '<div id="content">', '<div class="post-content">',
                  '<div class="article-body">', '<section class="entry">', "<div>", '<div class="text">',
                  '<main><article>', '<div class="page"><div class="story">', '<div role="main">',
                  '<section>', '<div class="container"><div class="row"><div class="col">']


def _close(box: str) -> str:
    return "".join(f"</{part.split()[0].strip('<>')}>" for part in reversed(box.split("<")[1:]))


class _Layouts:
    """Random pages with marked main text."""

    def __init__(self, paragraphs: list[str], labels: list[str], seed: int):
        self.random, self.paragraphs, self.labels = random.Random(seed), paragraphs, labels

    def text(self) -> str:
        whole = self.random.choice(self.paragraphs)
        if self.random.random() < 0.3:  # short paragraphs occur in main text too
            words = whole.split(" ")
            whole = " ".join(words[:self.random.randint(1, 12)])
        return whole

    def links(self, n: int, item: bool) -> str:
        some = [f'<a href="/{i}">{self.random.choice(self.labels)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{s}</li>" for s in some) + "</ul>" if item else " ".join(some)

    def paragraphs_of(self, n: int) -> str:
        return "".join(f"<p>{self.text()}</p>" for _ in range(n))

    def boilerplate(self) -> str:
        r = self.random
        n = r.randint(1, 4)
        kinds = [
            lambda: f"<nav>{self.links(r.randint(2, 9), r.random() < 0.7)}</nav>",
            lambda: self.box(["menu", "navbar", "breadcrumbs", "pagination"], self.links(r.randint(2, 8), r.random() < 0.6)),
            lambda: f"<header>{self.heading()}<p>{self.text()}</p></header>",
            lambda: self.box(["header", "masthead", "site-header", "branding"], self.mixed(n)),
            lambda: f"<footer>&copy; {r.choice(self.labels)} &middot; {self.text()}</footer>",
            lambda: f"<footer>{self.mixed(n)}</footer>",
            lambda: self.box(["footer", "site-footer", "copyright", "legal"], self.mixed(n)),
            lambda: f"<aside>{self.mixed(n)}</aside>",
            lambda: self.box(["sidebar", "side-column", "rail", "widget-area"], self.mixed(n)),
            lambda: self.box(["related", "recommended", "popular-posts", "share-links", "social"], self.mixed(n)),
            lambda: self.box(["ad", "ads", "advert", "ad-banner", "sponsored", "promo"], self.body(n)),
            lambda: self.box(["notice", "cookie-notice", "alert", "consent", "newsletter", "popup"], self.body(n)),
            lambda: f'<form action="/s"><label>{r.choice(self.labels)}</label><input name="q"><p>{self.text()}</p></form>',
            lambda: self.box(["comments", "comment-list", "discussion", "disqus"], self.comments(r.randint(1, 6))),
        ]
        return r.choice(kinds)()

    def heading(self) -> str:
        level = self.random.choice("123")
        return f"<h{level}>{self.text()[:60]}</h{level}>"

    def mixed(self, n: int) -> str:
        return (self.heading() if self.random.random() < 0.5 else "") + (
            self.links(n + 2, self.random.random() < 0.7) if self.random.random() < 0.5 else self.paragraphs_of(n))

    def body(self, n: int) -> str:
        return self.text() if self.random.random() < 0.5 else self.paragraphs_of(n)

    def comments(self, n: int) -> str:
        tag = self.random.choice(["div", "li", "article", "p"])
        name = self.random.choice([' class="comment"', ' class="reply"', ""])
        inner = lambda: self.text() if tag == "p" else self.paragraphs_of(self.random.randint(1, 2))
        one = "".join(f"<{tag}{name}>{inner()}</{tag}>" for _ in range(n))
        return f"<ul>{one}</ul>" if tag == "li" else one

    def box(self, names: list[str], inner: str) -> str:
        tag = self.random.choice(["div", "div", "section", "aside"])
        kind = self.random.choice(["class", "id"])
        return f'<{tag} {kind}="{self.random.choice(names)}">{inner}</{tag}>'

    def main(self) -> str:
        r = self.random
        out = [f"<h1>{MARK}{self.text()[:60]}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            if kind < 0.72:
                out.append(f"<p>{MARK}{self.text()}</p>")
            elif kind < 0.8:
                out.append(f"<p><b>{MARK}{self.text()}<br>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.text()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<h2>{MARK}{self.text()[:50]}</h2>")
            elif kind < 0.94:
                out.append(f"<blockquote>{MARK}{self.text()}</blockquote>")
            elif kind < 0.97:
                out.append(f"<div>{MARK}{self.text()}</div>")
            else:
                out.append(f"<table><tr><td>{MARK}{self.text()}</td><td>{MARK}{self.text()}</td></tr></table>")
            if r.random() < 0.06:
                out.append(self.boilerplate())
        return "".join(out)

    def page(self) -> str:
        r = self.random
        box = r.choice(_CONTENT_BOXES)
        before = "".join(self.boilerplate() for _ in range(r.randint(0, 4)))
        after = "".join(self.boilerplate() for _ in range(r.randint(0, 4)))
        inside = self.boilerplate() if r.random() < 0.25 else ""
        return f"<html><body>{before}{box}{self.main()}{inside}{_close(box)}{after}</body></html>"


def train(pages: DataFrame, id_column: str = "page_id", html: str = "html", sample: int = SAMPLE_PAGES,
          layouts: int = LAYOUTS, seed: int = SEED) -> dict:
    """The model, from the ``sample`` pages with the smallest hashes of id; the same each time."""
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"))
    short = pages.where(F.length(F.col(f"`{html}`")) <= SAMPLE_CHARS)
    # Ids first: no page is carried through the choice of the sample.
    ids = [r[0] for r in short.where(F.col(f"`{id_column}`").isNotNull()).select(
        F.col(f"`{id_column}`").alias("id"), key.alias("h")).distinct().orderBy("h", "id").limit(sample).collect()]
    texts = [r[0] for r in short.where(F.col(f"`{id_column}`").isin(ids)).select(
        F.col(f"`{html}`").alias("html")).distinct().orderBy("html").limit(sample).collect()] if ids else []
    return fit(texts, layouts, seed)


def fit(pages: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> dict:
    found = dom.Nodes()
    for page in pages:
        found.add(page, {})
    own = [t.lstrip(MARK) for t in found.texts if t]
    paragraphs = [t for t in own if len(t) >= 40] or ["A sentence, with some words in it, and another one."]
    labels = [t for t in own if len(t) < 40] or ["Home", "About", "News"]
    make = _Layouts(paragraphs, labels, seed)
    made = dom.Nodes()
    known: dict = {}
    for _ in range(layouts):
        made.add(make.page(), known)
    a, b = made.arrays(), found.arrays()
    x = [dom.features(a)]
    y = [dom.subtree_sum(np.array([bool(t) and t.startswith(MARK) for t in made.texts]), a["end"]) > 0]
    if len(b["page"]):
        label, labelled = _own_labels(found, b)
        x.append(dom.features(b)[labelled])
        y.append((dom.subtree_sum(label, b["end"]) > 0)[labelled])
    return boosting.train(np.concatenate(x), np.concatenate(y).astype(np.float64))


def _own_labels(nodes: dom.Nodes, a: dict) -> tuple[np.ndarray, np.ndarray]:
    """Runs within article or main and not within a part that is none of it; nodes of pages that have such."""
    inside = np.zeros(len(a["page"]), np.int64)  # 1 within main text, -1 within another part
    out = {dom.GROUPS.index(g) for g in ("nav", "header", "footer", "aside", "form")}
    good = {dom.GROUPS.index(g) for g in ("article", "main")}
    content = 1 << list(dom.TOKENS).index("content")
    for i, (parent, group, flags) in enumerate(zip(a["parent"], a["group"], a["flags"])):
        state = inside[parent] if parent >= 0 else 0
        if group in out or flags & ~content:
            state = -1
        elif group in good and state == 0:
            state = 1
        inside[i] = state
    label = (inside == 1) & (a["group"] == 0)
    has = np.bincount(a["page"], label, int(a["page"].max(initial=0)) + 1) > 0
    return label, has[a["page"]]


def main_texts(sources: list[str], model: dict, known: dict) -> list[str]:
    """The main text of each page: its kept runs in page order, one per line."""
    nodes = dom.Nodes()
    for source in sources:
        nodes.add(source, known)
    a = nodes.arrays()
    chosen = dom.choose(a, boosting.predict(model, dom.features(a)))
    out: list[list[str]] = [[] for _ in sources]
    for i in np.flatnonzero(chosen & (a["group"] == 0)).tolist():
        out[nodes.page[i]].append(nodes.texts[i])
    return ["\n".join(lines) for lines in out]


def extract(pages: DataFrame, model: dict, html: str = "html", out: str = "text") -> DataFrame:
    """The input's other columns and ``out``, the page's main text (empty if there is none).

    Blocks come in page order, one per line, character references decoded, white space as one space.
    Null pages count as empty; rows repeat as in the input; an empty table gives an empty one. The model
    has a fixed size and goes to every task.
    """
    keep = [c for c in pages.columns if c != html]
    if out in keep:
        raise ValueError(f"a column is already named {out}")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("int").alias("_")).alias("row"),
                        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            start = 0
            while start < len(batch):
                stop, size = start, 0
                while stop < len(batch) and stop - start < BATCH_PAGES and (size < BATCH_CHARS or stop == start):
                    size += len(batch.column(1)[stop].as_buffer())
                    stop += 1
                part = batch.slice(start, stop - start)
                texts = main_texts(part.column(1).to_pylist(), shared.value, known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", "text"])
                start = stop

    return rows.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in keep], F.col("text").alias(out))
