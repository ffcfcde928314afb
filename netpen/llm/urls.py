"""URL filters: rules by host and path, and link-graph propagation for what no rule judges.

Hosts that the rules mostly allow are trusted seeds, hosts that they mostly block are blocked seeds.
Trust is a personalised PageRank from the trusted seeds along the links between hosts; distrust is one from
the blocked seeds against them, since a host answers for what it links to. A host whose distrust
outweighs its trust by a threshold is blocked; others, those that neither reaches among them, are allowed.

Both run over one table of scores, one join and one aggregate per step, each step written out and the one
before deleted, until no score changes by more than ``TOLERANCE``. Scores are in units of one seed's share, so
that neither the verdicts nor the end of the walk depend on how many seeds there are; what reaches a host
without links onward starts again at the seeds. Links are first summed to edges between hosts, with partial sums before the shuffle, so a host with a third of all
pages has one row per host that it links to. Scores are written before they are joined: both sides of
the join are plain shuffles, which AQE splits at hosts with very many edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from netpen.session import release, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
SHARE = 0.5       # of a host's distrust in trust and distrust together, above which it is blocked
TOLERANCE = 1e-6  # of one seed's share: scores settle to within it, and distrust below it counts as none


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str     # starts with /

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
         Rule("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_by_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does; of equal length the first by text."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src``, ``dst`` and ``links`` between different hosts; relative links stay on their host."""
    # A tag reaches to the next < at most, which keeps the search in proportion to the page. Only links that
    # name a host matter: absolute ones, and those that start with //.
    tags = F.filter(F.split(F.col(f"`{html}`"), "<"), lambda tag: tag.rlike(r"^[aA]\s"))
    link = r"""(?is)^a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""
    links = pages.select(host_of(F.col(f"`{url}`")).alias("src"), F.explode(F.filter(F.transform(
        tags, lambda tag: F.regexp_extract(tag, link, 1)), lambda found: found != "")).alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link")))
    return links.select("src", dst.alias("dst")).where(
        "src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING,
              tolerance: float = TOLERANCE) -> DataFrame:
    """``host``, ``trust`` and ``distrust``: personalised PageRank along and against the edges.

    ``edges`` has src, dst, links; ``seeds`` has host and kind (trust or distrust), once each. The seeds of a
    kind share its restart evenly; scores are times their number. What reaches a host without edges onward
    starts again at the seeds. Hosts that nothing reaches have no row.
    """
    sizes = seeds.groupBy("kind").agg(F.count("*").alias("n"))  # two rows at most
    number = {r["kind"]: r["n"] for r in sizes.collect()}
    start = stage(seeds.join(F.broadcast(sizes), "kind").select(
        "kind", "host", (1 / F.col("n")).alias("score")), "seeds")
    moved, back = start.limit(0), dict.fromkeys(number, 1.0)
    if number and not edges.isEmpty():
        shares = _shares(edges)
        while True:
            after = stage(shares.join(_scores(moved, start, back).withColumnRenamed("host", "from"), ["kind", "from"])
                          .select("kind", F.col("to").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
                          .groupBy("kind", "host").agg(F.sum("score").alias("score")), "host-scores")
            # Per kind what moved on, and the largest change of a host's score: two rows.
            signed = after.select("kind", "host", "score", F.col("score").alias("change")).unionByName(
                moved.select("kind", "host", F.lit(0.0).alias("score"), (-F.col("score")).alias("change")))
            told = {r["kind"]: r for r in signed.groupBy("kind", "host").agg(
                F.sum("score").alias("score"), F.sum("change").alias("change")).groupBy("kind").agg(
                F.sum("score").alias("moved"), F.max(F.abs("change")).alias("change")).collect()}
            release(moved)
            before, moved = back, after
            back = {k: 1.0 - (told[k]["moved"] if k in told else 0.0) for k in number}
            if all((told[k]["change"] * n if k in told else 0.0) + abs(back[k] - before[k]) <= tolerance
                   for k, n in number.items()):
                break
        release(shares)
    part = lambda kind: F.coalesce(F.sum(F.when(
        F.col("kind") == kind, F.col("score") * number.get(kind, 0))), F.lit(0.0))
    return _scores(moved, start, back).groupBy("host").agg(
        part("trust").alias("trust"), part("distrust").alias("distrust"))


def _shares(edges: DataFrame) -> DataFrame:
    """Per kind the share of a host's score that each of its edges onward takes."""
    both = stage(edges.select(F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "links"),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "links")))),
        "host-edges")
    out = stage(both.groupBy("kind", "from").agg(F.sum("links").alias("out")), "edge-sums")
    shares = stage(both.join(out, ["kind", "from"]).select(
        "kind", "from", "to", (F.col("links") / F.col("out")).alias("share")), "edge-shares")
    release(both)
    release(out)
    return shares


def _scores(moved: DataFrame, start: DataFrame, back: dict[str, float]) -> DataFrame:
    """What moved, and what starts again at the seeds; a host may have a row of each."""
    times = F.lit(0.0)
    for kind, value in back.items():
        times = F.when(F.col("kind") == kind, F.lit(value)).otherwise(times)
    return moved.unionByName(start.select("kind", "host", (F.col("score") * times).alias("score")))


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, id_column: str = "page_id", url: str = "url",
               html: str = "html") -> DataFrame:
    """page id, host, path, rule and verdict (allow or block) of every row.

    The longest rule that fits decides; without one the host's trust and distrust do. A host is a trusted
    seed if rules allow more of its pages than they block, a blocked one if they block more than half
    of all its pages. Rows repeat as in the input; an empty table gives an empty one.
    """
    rules = RULES if rules is None else rules
    u = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{id_column}`").alias(id_column), host_of(u).alias("host"), path_of(u).alias("path"))
    text, verdict = judge_by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "ruled": verdict})
    hosts = rows.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"),
        F.count_if(F.col("ruled") == "block").alias("blocked"))
    kind = F.when(F.col("allowed") > F.col("blocked"), F.lit("trust")).when(
        2 * F.col("blocked") > F.col("pages"), F.lit("distrust"))
    seeds = stage(hosts.select("host", kind.alias("kind")).where("kind is not null"), "host-seeds")
    edges = stage(host_edges(pages, url, html), "host-links")
    scores = propagate(edges, seeds)
    bad = stage(scores.where((F.col("distrust") > TOLERANCE) & (
        F.col("distrust") > SHARE * (F.col("trust") + F.col("distrust")))).select(
        "host", F.lit(True).alias("bad")), "blocked-hosts")
    return rows.join(bad, "host", "left").select(
        id_column, "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
