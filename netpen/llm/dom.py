"""Pages as trees of block nodes and text runs, and the features of their nodes.

A run is the text between two block boundaries; inline markup is folded into it. Nodes are kept in page
order, each with the end of its subtree, so sums over subtrees are differences of running sums.
"""

from __future__ import annotations

import html
import re

import numpy as np

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^>\"'])*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Elements whose content is no text of the page; the parser passes over them.
SKIPPED = {"script", "style", "template", "head", "title", "iframe", "svg", "canvas",
           "audio", "video", "select", "textarea", "button", "datalist"}
RAW = {"script", "style", "title", "textarea", "iframe"}
# Groups of block elements; what is in none of them is inline.
GROUPS = ["run", "p", "h", "li", "list", "div", "section", "article", "main", "nav", "header", "footer", "aside",
          "form", "table", "quote", "figure", "other"]
_GROUP_OF = {"p": "p", **{f"h{i}": "h" for i in range(1, 7)}, "li": "li", "dt": "li", "dd": "li", "ul": "list",
             "ol": "list", "dl": "list", "menu": "list", "div": "div", "section": "section", "article": "article",
             "main": "main", "nav": "nav", "header": "header", "hgroup": "header", "footer": "footer",
             "aside": "aside", "form": "form", "fieldset": "form", "table": "table", "thead": "table",
             "tbody": "table", "tfoot": "table", "tr": "table", "td": "table", "th": "table", "caption": "table",
             "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "address": "other",
             "details": "other", "summary": "other", "dialog": "other", "center": "other", "body": "other",
             "html": "other", "hr": "other", "legend": "other"}
BLOCKS = {tag: GROUPS.index(group) for tag, group in _GROUP_OF.items()}
_P, _NAV = BLOCKS["p"], BLOCKS["nav"]
# A start tag ends the nearest open element of these, unless one of the others lies between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

# Attribute tokens by what they tell of an element.
TOKENS = {
    "menu": r"nav\w*|menu\w*|breadcrumbs?|pagination|pager|toolbar|topbar|navbar|tabs?|toc",
    "advert": r"ads?|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|outbrain|taboola",
    "comment": r"comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|reviews?",
    "notice": r"cookies?|consent|gdpr|notices?|notification\w*|alerts?|modal|popup|overlay|newsletter|subscri\w*|"
              r"signup|paywall|disclaimer|warning|toast|message",
    "share": r"shar\w+|social|related|recommend\w*|popular|trending|more|widget\w*|tags?|tagcloud",
    "frame": r"head|header|masthead|foot|footer|copyright|legal|colophon|login|search\w*|logo|branding",
    "side": r"side|sidebar|aside|rail|column|complementary|contentinfo",
    "form": r"form|contact|register|input|field",
    "content": r"content|article\w*|main|post|entry|body|text|story|blog|page|prose|paragraph",
}
_TOKEN_RES = [re.compile(rf"(?<![a-z])(?:{p})(?![a-z])") for p in TOKENS.values()]
_N = len(TOKENS)


def attribute_flags(attributes: str, known: dict) -> int:
    """A bit per kind of token."""
    words = []
    for match in ATTRIBUTE.finditer(attributes):
        words.append(match[1] or match[2] or match[3] or "")
    if not words:
        return 0
    text = " ".join(words)
    flags = known.get(text)
    if flags is None:
        spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower()
        flags = sum(1 << i for i, r in enumerate(_TOKEN_RES) if r.search(spaced))
        if len(known) < 10_000:
            known[text] = flags
    return flags


class Nodes:
    """The nodes of many pages, as columns."""

    def __init__(self):
        self.page, self.parent, self.end, self.group, self.flags = [], [], [], [], []
        self.depth, self.chars, self.linked, self.links, self.stops, self.texts = [], [], [], [], [], []
        self.pages = 0

    def add(self, source: str, known: dict) -> None:
        """Parse a page, in time that grows with its length, however deep it nests."""
        stack = [("", self._node(-1, BLOCKS["html"], 0))]  # open block elements
        places: dict[str, list[int]] = {}                  # of the open elements of each name in the stack
        parts: list[str] = []
        linked = links = 0
        in_link = False
        skipping = ""
        depth_skipped = 0

        def run() -> None:
            nonlocal linked, links, in_link
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    node = self._node(stack[-1][1], 0, 0)
                    self.end[node] = node + 1
                    self.texts[node] = text
                    self.chars[node] = len(text)
                    self.linked[node] = min(linked, len(text))
                    self.links[node] = links
                    self.stops[node] = text.count(".") + text.count("!") + text.count("?") + text.count(",")
                parts.clear()
            linked = links = 0
            in_link = False

        def close(upto: int) -> None:
            while len(stack) > upto:
                name, node = stack.pop()
                self.end[node] = len(self.page)
                if name:
                    places[name].pop()

        def nearest(names: set[str]) -> int:
            return max((places[name][-1] for name in names if places.get(name)), default=0)

        at = 0
        while (match := TOKEN.match(source, at)) is not None:
            at = match.end()
            tag = match[2]
            if tag is None:
                text = match[0]
                if not skipping and (text[0] != "<" or text == "<"):
                    parts.append(text)
                    if in_link:
                        linked += len(text)
                elif text.startswith("<![CDATA[") and not skipping:
                    parts.append(text[9:-3])
                continue
            tag = tag.lower()
            closing = match[1] == "/"
            if skipping:
                if tag == skipping:
                    depth_skipped += -1 if closing else 1
                    if depth_skipped == 0:
                        skipping = ""
                if skipping != "head" or tag != "body":
                    continue
                skipping = ""  # a head that never ends
            if tag in SKIPPED:
                if not closing and not match[3].endswith("/"):
                    if tag in RAW:
                        # Up to its end tag everything is raw text.
                        found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                        at = found.end() if found else len(source)
                    else:
                        skipping, depth_skipped = tag, 1
                continue
            group = BLOCKS.get(tag)
            if group is None:
                if tag == "a":
                    in_link = not closing
                    links += not closing
                elif tag in ("br", "img", "input", "wbr"):
                    parts.append(" " if tag == "br" else "")
                continue
            run()
            if closing:
                if places.get(tag):
                    close(places[tag][-1])
                continue
            if tag in ("html", "body"):
                continue
            if places.get("p"):  # no block stands in a paragraph
                close(places["p"][-1])
            elif tag in _ENDS:
                ended, walls = _ENDS[tag]
                at_ended = nearest(ended)
                if at_ended > nearest(walls):
                    close(at_ended)
            if tag == "hr":
                continue
            node = self._node(stack[-1][1], group, attribute_flags(match[3], known) if match[3] else 0)
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))
        run()
        close(0)
        self.pages += 1

    def _node(self, parent: int, group: int, flags: int) -> int:
        self.page.append(self.pages)
        self.parent.append(parent)
        self.end.append(0)
        self.group.append(group)
        self.flags.append(flags)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.texts.append(None)
        for column in (self.chars, self.linked, self.links, self.stops):
            column.append(0)
        return len(self.page) - 1

    def arrays(self) -> dict[str, np.ndarray]:
        names = ("page", "parent", "end", "group", "flags", "depth", "chars", "linked", "links", "stops")
        return {n: np.array(getattr(self, n), np.int64) for n in names}


def subtree_sum(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[end] - sums[:-1]


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def features(a: dict[str, np.ndarray]) -> np.ndarray:
    """One row per node: its own group and tokens, those above it, and its subtree and sibling figures."""
    n = len(a["page"])
    up = np.maximum(a["parent"], 0)
    is_run = a["group"] == 0
    groups = np.eye(len(GROUPS))[a["group"]]
    tokens = (a["flags"][:, None] >> np.arange(_N)) & 1
    own = np.concatenate([groups[:, 9:14], tokens], axis=1)  # nav to form, and the tokens
    above = np.zeros_like(own, dtype=np.float64)
    in_article = np.zeros(n)
    article = groups[:, 7] + groups[:, 8] > 0
    for at in levels(a["depth"])[1:]:
        above[at] = above[up[at]] + own[up[at]]
        in_article[at] = np.maximum(in_article[up[at]], article[up[at]])
    end = a["end"]
    size = end - np.arange(n)
    chars, linked = subtree_sum(a["chars"], end), subtree_sum(a["linked"], end)
    runs, stops = subtree_sum(is_run, end), subtree_sum(a["stops"], end)
    paragraphs = subtree_sum(a["group"] == _P, end)
    headings, items = subtree_sum(a["group"] == 2, end), subtree_sum(a["group"] == 3, end)
    navs = subtree_sum(a["group"] == _NAV, end)
    roots = a["depth"] == 0
    total = chars[roots][a["page"]]
    first = np.flatnonzero(roots)[a["page"]]
    before = np.concatenate([[0], np.cumsum(a["chars"])])
    before = before[:-1] - before[first]
    children = np.bincount(up[a["parent"] >= 0], minlength=n)
    same, same_inverse, same_count = np.unique(up * len(GROUPS) + a["group"], return_inverse=True, return_counts=True)
    sibling_chars = np.maximum(chars[up] - chars, 0) / np.maximum(children[up] - 1, 1)
    columns = [
        a["depth"], np.log1p(chars), linked / np.maximum(chars, 1), np.log1p(subtree_sum(a["links"], end)),
        np.log1p(size), chars / size, np.log1p(runs), chars / np.maximum(runs, 1), stops / np.maximum(chars, 1) * 100,
        np.log1p(paragraphs), np.log1p(headings), np.log1p(items), np.log1p(navs), chars / np.maximum(total, 1),
        before / np.maximum(total, 1), children, children[up], same_count[same_inverse], np.log1p(sibling_chars),
        linked[up] / np.maximum(chars[up], 1), chars[up] / np.maximum(total, 1), in_article]
    return np.concatenate([np.stack(columns, axis=1).astype(np.float64), groups, groups[up], tokens, tokens[up], above],
                          axis=1)


def choose(a: dict[str, np.ndarray], score: np.ndarray) -> np.ndarray:
    """The labelling of highest likelihood in which nothing under a rejected node is kept.

    ``score`` is each node's log odds. Rejecting a node costs the odds of all nodes below it; keeping it lets
    each child choose. Roots are always kept.
    """
    log_yes, log_no = -np.logaddexp(0, -score), -np.logaddexp(0, score)
    rejected = subtree_sum(log_no, a["end"])
    kept = log_yes.copy()
    by_depth = levels(a["depth"])
    for level in reversed(by_depth[1:]):
        np.add.at(kept, a["parent"][level], np.maximum(kept[level], rejected[level]))
    chosen = np.zeros(len(score), bool)
    if by_depth:
        chosen[by_depth[0]] = True
    for level in by_depth[1:]:
        chosen[level] = chosen[a["parent"][level]] & (kept[level] > rejected[level])
    return chosen
