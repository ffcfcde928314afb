"""Secret scans over a trigram inverted index.

Each rule's regular expression yields a Boolean trigram query (``trigrams``). The index holds, for the
trigrams that any rule asks for, one posting per trigram and text that has it. A rule's candidates
are found by joining its clauses to the postings and keeping the texts that have all trigrams of a
clause; candidates are joined back to the texts and verified by the expression itself. Rules without
mandatory trigrams scan every text.

Postings and candidates name a text by a 64-bit hash of its row. Texts that share a hash are candidates
together; verification sees to the result. Postings are spread by that hash, so a frequent trigram is
no hot key; copies of a row have one posting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from netpen.llm.trigrams import ANY, trigram_query
from netpen.session import stage


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str        # the same meaning in Java and in Python
    group: int = 0      # the group whose length counts
    least: int = 1      # characters in that group
    paired: bool = False  # the pattern matches the edges of a block; a span is a whole block


# A private key's first and last line.
KEY_EDGE = r"-----(?:BEGIN|END)\x20[A-Z\x20]{0,40}PRIVATE KEY-----"
# What a line of a key without END may be: key text from its start, a header, or the short last line. Blanks
# may stand between its parts. No group repeats, so matching needs no recursion, however long a line is.
KEY_TEXT = r"^[A-Za-z0-9+/=\x20\t]*[A-Za-z0-9+/]{20}[A-Za-z0-9+/]*={0,2}(?:\x20[A-Za-z0-9+/]{1,19}={1,2})?"
KEY_HEADER = r"^[\x20\t]*[A-Za-z-]+:\x20"
KEY_LAST = r"^[\x20\t]*[A-Za-z0-9+/]{1,19}={0,2}[\x20\t]*$"


# The first three are the base rules; their order is that of equal starts.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Equal to the runs of [0-9a-f]+ with 16 characters or more: shorter runs hold no match.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("private_key", KEY_EDGE, 0, 1, paired=True),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 40),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
]
BASE_KINDS = ("assign", "access", "hex")


def _running_sums(lengths: str, block: int = 256) -> Column:
    """The sums of the entries before each entry of an array column.

    Blocks of entries are summed first, so that long arrays take time in proportion to their length
    and not to its square.
    """
    def before(values: Column, start: Column) -> Column:
        return F.aggregate(
            values, F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, v: F.struct((acc["sum"] + v).alias("sum"),
                                    F.concat(acc["out"], F.array(acc["sum"])).alias("out")),
            lambda acc: acc["out"])

    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")),
                         lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    sums = F.transform(blocks, lambda part: F.aggregate(part, zero, lambda a, v: a + v))
    return F.when(F.size(lengths) <= block, before(F.col(lengths), zero)).otherwise(F.flatten(
        F.transform(F.arrays_zip(blocks.alias("part"), before(sums, zero).alias("start")),
                    lambda x: before(x["part"], x["start"]))))


def postings(docs: DataFrame, key: str, text: str, grams: list[str]) -> DataFrame:
    """``key`` and ``gram`` (the trigram's number) for each of the trigrams that a text has."""
    lowered = docs.select(key, F.lower(text).alias("lowered"))
    return lowered.select(key, F.explode(F.array_compact(F.array(
        *[F.when(F.contains("lowered", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))).alias("gram"))


def candidates(docs: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """``key`` and ``rules`` (sorted numbers of the rules whose trigram query the text satisfies).

    Rules without mandatory trigrams are left out: every text is a candidate of theirs.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ANY}
    grams = sorted({g for q in queries.values() for clause in q for g in clause})
    number = {g: i for i, g in enumerate(grams)}
    clauses = [(i, sorted(number[g] for g in clause)) for i, q in sorted(queries.items())
               for clause in sorted(q, key=sorted)]
    spark = docs.sparkSession
    # One row per rule, clause and trigram: bounded by the rules.
    asked = spark.createDataFrame(
        [(rule, at, gram, len(wanted)) for at, (rule, wanted) in enumerate(clauses) for gram in wanted],
        "rule int, clause int, gram int, wanted int")
    found = postings(docs, key, text, grams).join(F.broadcast(asked), "gram")
    # Intersection: the texts in the postings of all of a clause's trigrams.
    hits = found.groupBy(key, "rule", "clause", "wanted").agg(F.count_distinct("gram").alias("n"))
    return hits.where(F.col("n") == F.col("wanted")).groupBy(key).agg(
        F.sort_array(F.collect_set("rule")).alias("rules"))


def _matches(rule: Rule, text: Column) -> Column:
    """The pieces between a rule's matches, the matches, and the groups whose length counts."""
    pattern = F.lit(rule.pattern)
    return F.struct(F.split(text, rule.pattern, -1).alias("pieces"),
                    F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"),
                    F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("groups"))


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The input with ``spans``: kind, start and end (code points, end exclusive) of each match.

    Matches are leftmost and non-overlapping per rule; those whose counted group is too short are dropped
    afterwards. A private key reaches from its BEGIN line through the next END line, unless another BEGIN line or
    five dashes stand between; without END it reaches over the key and header lines that follow, however many. Spans are sorted by start, then by the rules' order. Null texts count as empty and have
    none. Repeated rows each have theirs. An empty table gives an empty one.
    """
    rules = RULES if rules is None else rules
    if "spans" in docs.columns:
        raise ValueError("a column is already named spans")
    clean = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), clean.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("row"))
    wanted = stage(candidates(rows, "key", "text", rules), "secret-candidates")
    # The candidates' side is a few numbers per text; texts need no sorting for a hash join.
    out = rows.join(wanted.hint("shuffle_hash"), "key", "left").select("row", "text", "rules")
    due = [F.lit(True) if trigram_query(r.pattern) == ANY
           else F.coalesce(F.array_contains("rules", i), F.lit(False)) for i, r in enumerate(rules)]
    out = out.select("row", *[
        F.when(due[i] & F.col("text").rlike(r.pattern), _matches(r, F.col("text"))).alias(f"m{i}")
        for i, r in enumerate(rules)])
    # The pieces and matches alternate: their lengths' running sums are the positions.
    out = out.select("row", *[f"m{i}" for i in range(len(rules))], *[F.when(
        F.col(f"m{i}").isNotNull(), F.flatten(F.transform(
            F.arrays_zip(f"m{i}.pieces", f"m{i}.matches"), lambda z: F.array(
                F.length(z["pieces"]).cast("long"),
                F.coalesce(F.length(z["matches"]), F.lit(0)).cast("long"))))).alias(f"l{i}")
        for i in range(len(rules))])
    out = out.select("*", *[F.when(F.col(f"l{i}").isNotNull(), _running_sums(f"l{i}")).alias(f"p{i}")
                            for i in range(len(rules))])
    spans = [F.when(F.col(f"m{i}").isNotNull(), _blocks(i, r) if r.paired else _long_enough(i, r)).otherwise(
        F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>"))
        for i, r in enumerate(rules)]
    return out.select("row.*", F.transform(F.array_sort(F.concat(*spans)), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def _long_enough(i: int, rule: Rule) -> Column:
    numbers = F.filter(F.sequence(F.lit(0), F.size(f"m{i}.matches") - 1),
                       lambda m: F.length(F.col(f"m{i}.groups")[m]) >= rule.least)
    return F.transform(numbers, lambda m: F.struct(
        F.col(f"p{i}")[2 * m + 1].alias("start"), F.lit(i).alias("place"),
        (F.col(f"p{i}")[2 * m + 1] + F.col(f"l{i}")[2 * m + 1]).alias("end"),
        F.lit(rule.kind).alias("kind")))


def _blocks(i: int, rule: Rule) -> Column:
    """A span from each BEGIN edge to where its block ends."""
    matches = F.col(f"m{i}.matches")
    numbers = F.filter(F.sequence(F.lit(0), F.size(matches) - 1), lambda m: matches[m].startswith("-----BEGIN"))

    def end(m: Column) -> Column:
        start, length = F.col(f"p{i}")[2 * m + 1], F.col(f"l{i}")[2 * m + 1]
        after = F.col(f"m{i}.pieces")[m + 1]
        closed = F.coalesce(F.get(matches, m + 1).startswith("-----END"), F.lit(False)) & ~F.contains(after, F.lit("-----"))
        return F.when(closed, F.get(F.col(f"p{i}"), 2 * m + 3) + F.get(F.col(f"l{i}"), 2 * m + 3)).otherwise(
            start + length + key_length(after))

    return F.transform(numbers, lambda m: F.struct(
        F.col(f"p{i}")[2 * m + 1].alias("start"), F.lit(i).alias("place"), end(m).alias("end"),
        F.lit(rule.kind).alias("kind")))


def key_length(text: Column) -> Column:
    """How many characters of a text that follows a BEGIN edge are the key's: a fold over its lines.

    Headers count until the first key text; blank lines count if key text or a header follows. A line that is
    key text to its end goes on, one that is so in part ends the key there, a short last line ends it after
    itself, any other line before itself. Line ends may also be written as \\n.
    """
    # Of the same length, with one character per line end.
    lines = F.split(F.regexp_replace(F.translate(text, "\r", " "), r"\\\\[rn]", " \n"), "\n", -1)
    zero = F.lit(0).cast("long")

    def described(line: Column) -> Column:
        body = F.length(F.regexp_extract(line, KEY_TEXT, 0))
        whole = F.length(F.rtrim(line, F.lit(" \t")))
        return F.struct(
            F.length(line).alias("length"), body.alias("body"), whole.alias("whole"),
            (whole == 0).alias("blank"), line.rlike(KEY_HEADER).alias("header"), line.rlike(KEY_LAST).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        key = x["body"] > 0
        header, last = x["header"] & ~acc["key"], x["last"] & acc["key"]
        used = F.when(key, x["body"]).when(header | last, x["whole"])
        return F.when(~acc["open"], acc).otherwise(F.struct(
            (acc["at"] + x["length"] + 1).alias("at"),
            F.coalesce(acc["at"] + used, acc["used"]).alias("used"),
            (acc["key"] | key).alias("key"),
            F.when(key, x["body"] >= x["whole"]).otherwise(x["blank"] | header).alias("open")))

    start = F.struct(zero.alias("at"), zero.alias("used"), F.lit(False).alias("key"), F.lit(True).alias("open"))
    return F.aggregate(F.transform(lines, described), start, step, lambda acc: acc["used"])


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The input with every span of ``scan`` replaced by ``mark``; spans that touch or overlap share one.

    Texts without spans, null ones included, stay as they are.
    """
    found = scan(docs, text)
    # Spans come sorted by start; the last of the merged ones grows while the next begins within it.
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    merged = F.aggregate("spans", empty, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
            F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(
        F.concat(acc, F.array(one(s)))))
    found = found.withColumn("spans", F.when(F.size("spans") > 0, merged))
    clean = F.col(f"`{text}`")
    pieces = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.substring(
        clean, F.coalesce(F.get(F.col("spans"), i - 1)["end"], F.lit(0)).cast("int") + 1,
        (F.coalesce(F.get(F.col("spans"), i)["start"], F.length(clean).cast("long"))
         - F.coalesce(F.get(F.col("spans"), i - 1)["end"], F.lit(0))).cast("int")))
    new = F.when(F.col("spans").isNotNull(), F.array_join(pieces, mark)).otherwise(clean)
    return found.select(*[new.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
