"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

import itertools
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from netpen.llm import (
    align, bpe, bytebpe, extract, filter_audit, mixing, quality, secrets, simhash, substring, topk, urls, warc,
)
from netpen.llm.common import configure, table
from netpen.session import stage, staging_root


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded text."""
    configure(spark)
    vocabulary = bpe.read_vocabulary(vocabulary_path())
    ids = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    rows = ids.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    rows = rows.withColumn("ids_sha256", F.sha2("ids", 256))
    return bpe.decode(rows, vocabulary).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    configure(spark)
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives: what reading them back gives."""
    configure(spark)
    path = f"{staging_root(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = stage(warc.read_archives(spark, path).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest",
        "record_type", "refers_to"), "warc-records")
    # A revisit's payload is that of the response it refers to.
    sizes = stage(read.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("digest")).agg(
        F.max("payload_bytes").alias("full_bytes")), "warc-payloads")
    revisits = read.where("record_type = 'revisit'").join(
        sizes, F.col("payload_digest") == F.col("digest")).withColumn("payload_bytes", F.col("full_bytes"))
    return read.where("record_type = 'response'").unionByName(revisits.select(*read.columns))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, all spans."""
    configure(spark)
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
              for k in secrets.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors of each vector whose id is divisible by 20."""
    configure(spark)
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where(F.col("id") % 20 == 0), vectors, 20)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the outlier verdict of every document."""
    configure(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = stage(quality.statistics(docs).drop("text"), "quality-statistics")
    return quality.judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                       "n_repeat_words", "base_failed", "kept", "distance")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    configure(spark)
    pages = table(spark, sf_dir, "pages")
    found = extract.extract(pages, extract.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component of near duplicates it belongs to."""
    configure(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    configure(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep=["doc_id"])


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated runs of 35 words."""
    configure(spark)
    left = substring.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by ranks; digests of the ids and of the decoded bytes."""
    import public_tokenizers

    configure(spark)
    ranks = bytebpe.read_ranks(vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    ids = bytebpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    rows = ids.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    rows = rows.withColumn("ids_sha256", F.sha2("ids", 256))
    return bytebpe.decode(rows, ranks).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens of every document overlap, and how common their pairs are corpus-wide."""
    configure(spark)
    vocabularies = align.read_vocabularies(vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
    return align.align(table(spark, sf_dir, "documents"), vocabularies, keep=["doc_id"])


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from the documents, in every order."""
    configure(spark)
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _both_cases(pattern: str) -> str:
    """(?i:...) spelled out for A-Z alone: RE2 also folds letters beyond ASCII."""
    return re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub(
        "[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern)


def _op4_sql() -> str:
    rules = []
    for place, rule in enumerate(secrets.RULES):
        pattern = _both_cases(rule.pattern).replace("'", "''")
        rules.append(f"""
          SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, {rule.paired} AS paired, i,
                 string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', 0) AS m,
                 regexp_extract_all(t, '{pattern}', {rule.group}) AS g
          FROM d, unnest(range(1, len(regexp_extract_all(t, '{pattern}', 0)) + 1)) AS u(i)""")
    joined = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) {0}, '')"
    base = "FILTER (place < 3)"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({" UNION ALL ".join(rules)}),
        placed AS (
          SELECT *, CAST(list_sum([len(x) FOR x IN p[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i - 1]]), 0)
                         AS BIGINT) AS a FROM found),
        begun AS (
          SELECT doc_id, place, kind, a, i, a + len(m[i]) AS after, p[i + 1] AS rest,
                 coalesce(starts_with(m[i + 1], '-----END') AND NOT contains(p[i + 1], '-----'), false) AS closed,
                 len(m[i]) + len(p[i + 1]) + len(m[i + 1]) AS size
          FROM placed WHERE paired AND starts_with(m[i], '-----BEGIN')),
        open_line AS (
          SELECT doc_id, i, j, lines[j] AS line, CAST(coalesce(list_sum([len(x) + 1 FOR x IN lines[1:j - 1]]), 0) AS BIGINT) AS begins
          FROM (SELECT doc_id, i, string_split(regexp_replace(replace(rest, chr(13), ' '), '\\[rn]', ' ' || chr(10), 'g'),
                       chr(10)) AS lines FROM begun WHERE NOT closed), unnest(range(1, len(lines) + 1)) AS u(j)),
        described AS (
          SELECT *, len(regexp_extract(line, '{secrets.KEY_TEXT}')) AS body, len(rtrim(line, ' ' || chr(9))) AS whole,
                 regexp_matches(line, '{secrets.KEY_HEADER}') AS header, regexp_matches(line, '{secrets.KEY_LAST}') AS last
          FROM open_line),
        seen AS (
          SELECT *, coalesce(max(body) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                             0) > 0 AS key
          FROM described),
        judged AS (
          SELECT *, CASE WHEN body > 0 THEN body WHEN (header AND NOT key) OR (last AND key) THEN whole END AS used,
                 CASE WHEN body > 0 THEN body >= whole ELSE whole = 0 OR (header AND NOT key) END AS goes_on
          FROM seen),
        kept AS (
          SELECT *, coalesce(bool_and(goes_on) OVER (PARTITION BY doc_id, i ORDER BY j
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS reached
          FROM judged),
        tails AS (SELECT doc_id, i, max(begins + used) FILTER (reached) AS tail FROM kept GROUP BY doc_id, i),
        spans AS (
          SELECT doc_id, place, kind, a, a + len(m[i]) AS b FROM placed WHERE NOT paired AND len(g[i]) >= least
          UNION ALL
          SELECT doc_id, place, kind, a, CASE WHEN closed THEN a + size ELSE after + coalesce(tail, 0) END
          FROM begun LEFT JOIN tails USING (doc_id, i))
        SELECT d.doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
               count(*) FILTER (place = 2) AS n_hex, sha256({joined.format(base)}) AS base_sha256,
               {joined.format("")} AS spans
        FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


OP10_SQL = """
WITH w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws
  FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 35], ' ')) AS h FROM w, unnest(range(0, len(ws) - 34)) AS u(i)),
flagged AS (
  SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
words AS (SELECT doc_id, unnest(range(0, len(ws))) AS j, unnest(ws) AS word FROM w),
marked AS (
  SELECT words.doc_id, j, word, max(i) OVER (
    PARTITION BY words.doc_id ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN flagged ON flagged.doc_id = words.doc_id AND i = j)
SELECT w.doc_id, count(j) AS n_words, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN marked USING (doc_id) GROUP BY w.doc_id
"""

def _op13_sql() -> str:
    names = "ABCDE"
    steps = ", ".join(
        f"('{''.join(order)}', {step + 1}, {1 << names.index(name)}, {sum(1 << names.index(n) for n in order[:step])})"
        for order in itertools.permutations(names) for step, name in enumerate(order))
    total = "CAST(coalesce(sum({0}) FILTER (WHERE {1}), 0) AS BIGINT) AS {2}"
    gone = "m & f <> 0 AND m & b = 0"
    columns = ",\n       ".join(total.format(*c) for c in [
        ("n", "m & (f | b) = 0", "kept"), ("n", gone, "removed"), ("n", "m & f <> 0 AND m & b <> 0", "redundant"),
        ("n", "m = f", "unique_fails"), ("good", gone, "good_lost"), ("toxic", gone, "toxic_lost")])
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
         [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws
  FROM documents),
flagged AS (
  SELECT part, CAST(len(ws) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INTEGER)
         + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS INTEGER)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
         + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS m,
         CAST(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS INTEGER) AS g,
         CAST(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS INTEGER) AS x
  FROM w),
classes AS (SELECT part, m, count(*) AS n, sum(g) AS good, sum(x) AS toxic FROM flagged GROUP BY part, m),
steps(filter_order, step, f, b) AS (VALUES {steps}),
counted AS (
  SELECT part, filter_order, step, f,
       {columns}
  FROM classes CROSS JOIN steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_urls": op2_urls,
    "op3_warc": op3_warc,
    "op4_secrets": op4_secrets,
    "op5_topk": op5_topk,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_substring": op10_substring,
    "op11_bytebpe": op11_bytebpe,
    "op12_align": op12_align,
    "op13_filters": op13_filters,
}
ORACLES = {"op4_secrets": _op4_sql(), "op5_topk": OP5_SQL, "op10_substring": OP10_SQL, "op13_filters": _op13_sql()}
