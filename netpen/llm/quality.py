"""Quality rules: robust multivariate outliers per language and source.

Every text gets a few counts (``statistics``), all computed inside its row. The counts become a vector
of transformed ratios; per language and source the minimum-covariance-determinant estimate of centre
and scatter is found by concentration steps, and texts far from the centre by Mahalanobis distance
are rejected.

Vectors are whole numbers on a fixed grid, so all sums are exact and reruns agree. A concentration
step is one aggregate of sums and products per group, with partial sums before the shuffle, and one
histogram of distances per group on a fixed logarithmic grid, from which the nearest ``SHARE`` of the
rows is read; no group is gathered or sorted. Each group takes steps for as long as they shrink its scatter's
determinant; floors bound it from below. The starting half is chosen around the coordinates'
medians, scaled by their median absolute deviations, both read from histograms too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netpen.llm.common import SPACE_CLASS, SPACES
from netpen.session import stage

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

GRID = 256          # vector coordinates are whole multiples of 1/GRID
LIMIT = 16 * GRID   # and lie within +-LIMIT
SHARE = 0.5         # of a group's rows that the estimate rests on: copies of one text may be near half
SETTLED = 0.01      # a step that shrinks the logarithm of the scatter's determinant by no more is a group's last
CONSISTENCY = 1.91  # makes the scatter of the nearest half fit a normal sample in 5 dimensions
MIN_GROUP = 60      # sources with fewer rows are pooled per language, then over the corpus
# Least standard deviation per coordinate, so that a coordinate that hardly varies in clean texts
# rejects only texts far off. Each coordinate alone can pass CUT: repeated lines from one in 16 words on,
# and repeated windows from 16 % of the words on, below the base rule's 30 %.
FLOORS = {"x_length": 1.0, "x_word": 0.15, "x_symbols": 0.1, "x_lines": 0.05, "x_repeats": 0.08}
CUT = 25.0          # squared Mahalanobis distance; chi-squared with 5 degrees has 1.4e-4 beyond it
BINS_PER_UNIT = 32  # of the histogram of ln(1 + squared distance)

AXES = list(FLOORS)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (longs).

    Words are runs without ASCII white space. Null and empty texts have zeros throughout. Repeated
    windows are found by 64-bit hashes of word hashes within one text.
    """
    inputs = docs.columns
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    if clash := set(names) & set(inputs):
        raise ValueError(f"columns already named {sorted(clash)}")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in inputs]).alias("row"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    row = row.withColumn("trimmed", F.btrim("text", F.lit(SPACES)))
    row = row.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>"))
                         .otherwise(F.split("trimmed", f"[{SPACE_CLASS}]+")))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    row = row.select("row", "text", lines.alias("lines"), "words",
                     F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.col("h")[i + k] for k in range(WINDOW)]))).otherwise(
        F.array().cast("array<bigint>"))
    row = row.select(
        "row", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"))
    kept = ["row", *names[:-1]]
    # Only texts with a repeated window are sorted: windows by hash, then the repeated ones by place.
    row = row.select(*kept, F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
        .alias("s"))
    last = F.size("s") - 1

    def is_repeated(x: Column, i: Column) -> Column:
        same_before = (i > 0) & (F.col("s")[F.greatest(i - 1, F.lit(0))]["w"] == x["w"])
        return same_before | ((i < last) & (F.col("s")[F.least(i + 1, last)]["w"] == x["w"]))

    row = row.select(*kept, F.when(F.col("s").isNotNull(), F.sort_array(F.transform(
        F.filter("s", is_repeated), lambda x: x["i"]))).alias("p"))
    gaps = F.aggregate(F.sequence(F.lit(1), F.size("p") - 1), F.lit(WINDOW).cast("long"),
                       lambda total, k: total + F.least(F.col("p")[k] - F.col("p")[k - 1], F.lit(WINDOW)))
    repeats = F.when(F.col("p").isNotNull(), gaps).otherwise(0).cast("long").alias(names[-1])
    # Through a one-element generator: later filters must not repeat all this.
    return row.select("row.*", F.inline(F.array(F.struct(*names[:-1], repeats))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vector() -> dict[str, Column]:
    """The transformed counts on the grid."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    axes = {
        "x_length": F.log1p(F.col("n_words")),
        "x_word": F.log1p(F.col("word_chars") / n),
        "x_symbols": F.sqrt(F.col("n_symbols") / n),
        "x_lines": F.sqrt(F.col("n_dup_lines") / n),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }
    return {name: F.least(F.greatest(F.rint(x * GRID), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long")
            for name, x in axes.items()}


def judge(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The output of ``statistics`` with ``base_failed``, ``distance`` and ``kept``.

    Texts that fail a base rule are not kept and take no part in the estimates (distance null). Of the
    others those further than ``CUT`` from their group's centre are not kept. Null languages and
    sources are groups like any other. A pool of fewer than ``MIN_GROUP`` texts is not judged: its
    texts are kept, with null distance. An empty table gives an empty one.
    """
    added = ["base_failed", "distance", "kept"]
    if clash := set(added) & set(stats.columns):
        raise ValueError(f"columns already named {sorted(clash)}")
    rows = stats.select(
        F.struct(*[F.col(f"`{c}`") for c in stats.columns]).alias("row"), F.col(f"`{lang}`").alias("lang"),
        F.col(f"`{source}`").alias("source"), base_failed().alias("failed"),
        F.inline(F.array(F.struct(*[x.alias(name) for name, x in _vector().items()]))))
    # Only vectors are written for the estimate; the rows themselves are read again to be judged.
    light = stage(rows.select("lang", "source", "failed", *AXES), "quality-rows")
    groups = stage(_groups(light.where(~F.col("failed"))), "quality-groups")
    vectors = stage(_placed(light, groups).where("group is not null").select("group", *AXES), "quality-vectors")
    judged = _placed(rows, groups).select("row", "failed", "group", *AXES).join(_estimate(vectors), "group", "left")
    return judged.select("row.*", F.col("failed").alias("base_failed"), _distance().alias("distance")).select(
        "*", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)).alias("kept"))


def _placed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.alias("r").join(
        groups.alias("g"), F.col("r.lang").eqNullSafe(F.col("g.lang"))
        & F.col("r.source").eqNullSafe(F.col("g.source")) & ~F.col("failed"), "left")


def _groups(rows: DataFrame) -> DataFrame:
    """The group of each language and source that is judged: its own, or a pool of small sources."""
    counts = stage(rows.groupBy("lang", "source").count(), "quality-counts")
    small = counts.where(F.col("count") < MIN_GROUP)
    pools = stage(small.groupBy(F.col("lang").alias("pool")).agg(F.sum("count").alias("pooled")), "quality-pools")
    rest = pools.where(F.col("pooled") < MIN_GROUP).agg(F.sum("pooled")).first()[0] or 0
    key = F.when(F.col("count") >= MIN_GROUP, F.concat(F.lit("source "), F.to_json(F.struct("lang", "source"))))
    key = key.when(F.col("pooled") >= MIN_GROUP, F.concat(F.lit("language "), F.to_json(F.struct("lang"))))
    key = key.when(F.lit(rest >= MIN_GROUP), F.lit("corpus"))
    return counts.join(pools, F.col("lang").eqNullSafe(F.col("pool")), "left").select(
        "lang", "source", key.alias("group"))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(AXES)) for j in range(i + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined to its group's parameters."""
    z = [(F.col(x) / F.lit(float(GRID)) - F.col(f"mean_{i}")) for i, x in enumerate(AXES)]
    total = None
    for i in range(len(AXES)):
        y = None
        for j in range(i + 1):
            part = F.col(f"inv_{i}_{j}") * z[j]
            y = part if y is None else y + part
        total = y * y if total is None else total + y * y
    return total


def _distance_bin() -> Column:
    return F.least(F.floor(F.log1p(_distance()) * BINS_PER_UNIT), F.lit(100 * BINS_PER_UNIT)).cast("int")


def _quantile(histogram: DataFrame, keys: list[str], share: float, value: str) -> DataFrame:
    """Per key the least bin with at least ``share`` of the rows at or below it.

    ``histogram`` has one row per key and bin: at most as many rows per key as the grid has bins.
    """
    in_order = Window.partitionBy(*keys).orderBy("bin")
    reached = histogram.select(
        *keys, "bin", F.sum("count").over(in_order).alias("below"),
        F.sum("count").over(Window.partitionBy(*keys)).alias("all"))
    return reached.where(F.col("below") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(
        F.min("bin").alias(value))


def _by_axis(vectors: DataFrame, centre: DataFrame | None = None) -> DataFrame:
    """Per group and axis the median, or with ``centre`` the median absolute deviation from it."""
    cells = vectors.select("group", F.posexplode(F.array(*AXES)).alias("axis", "x"))
    if centre is not None:
        at = centre.groupBy("group").pivot("axis", list(range(len(AXES)))).agg(F.first("median"))
        cells = vectors.join(at, "group").select("group", F.posexplode(F.array(
            *[F.abs(F.col(x) - F.col(str(i))) for i, x in enumerate(AXES)])).alias("axis", "x"))
    histogram = cells.groupBy("group", "axis", F.col("x").alias("bin")).count()
    return _quantile(histogram, ["group", "axis"], 0.5, "median")


def _estimate(vectors: DataFrame) -> DataFrame:
    """Per group the centre (mean_i) and the inverse Cholesky factor of the scatter (inv_i_j)."""
    medians = stage(_by_axis(vectors), "quality-medians")
    spreads = _by_axis(vectors, medians).withColumnRenamed("median", "spread")
    both = medians.join(spreads, ["group", "axis"]).groupBy("group")
    wide = both.pivot("axis", list(range(len(AXES)))).agg(
        F.first("median").alias("m"), F.first("spread").alias("s"))
    columns = {f"mean_{i}": F.col(f"{i}_m") / float(GRID) for i in range(len(AXES))}
    for i, j in _pairs():
        scale = F.greatest(1.4826 * F.col(f"{i}_s") / float(GRID), F.lit(FLOORS[AXES[i]]))
        columns[f"inv_{i}_{j}"] = 1 / scale if i == j else F.lit(0.0)
    params = stage(wide.select("group", *[c.alias(n) for n, c in columns.items()],
                               F.lit(float("inf")).alias("size")), "quality-start")
    settled = []
    while not params.isEmpty():
        near = vectors.join(params.drop("size"), "group")
        cut = _quantile(near.groupBy("group", _distance_bin().alias("bin")).count(),
                        ["group"], SHARE, "last_bin")
        params = stage(params.join(cut, "group").withColumnRenamed("size", "before"), "quality-cut")
        chosen = vectors.join(params.drop("before"), "group").where(_distance_bin() <= F.col("last_bin"))
        sums = chosen.groupBy("group").agg(
            F.count("*").alias("m"), *[F.sum(x).alias(f"sum_{i}") for i, x in enumerate(AXES)],
            *[F.sum(F.col(AXES[i]) * F.col(AXES[j])).alias(f"sum_{i}_{j}") for i, j in _pairs()])
        after = stage(_factor(sums).join(params.select("group", "before"), "group"), "quality-step")
        # A group goes on while its scatter shrinks.
        shrinks = F.col("size") < F.col("before") - SETTLED
        settled.append(after.where(~shrinks).drop("before", "size"))
        params = after.where(shrinks).drop("before")
    out = params.drop("size")
    for one in settled:
        out = out.unionByName(one)
    return out


def _factor(sums: DataFrame) -> DataFrame:
    """Centre, scatter, its Cholesky factor and that factor's inverse, one row per group."""
    size, m = len(AXES), F.col("m")
    out = sums.withColumns({f"mean_{i}": F.col(f"sum_{i}") / m / float(GRID) for i in range(size)})
    for i, j in _pairs():
        scatter = (F.col(f"sum_{i}_{j}") / m / float(GRID * GRID)
                   - F.col(f"mean_{i}") * F.col(f"mean_{j}")) * CONSISTENCY
        left = scatter + F.lit(FLOORS[AXES[i]] ** 2) if i == j else scatter
        for k in range(j):
            left = left - F.col(f"low_{i}_{k}") * F.col(f"low_{j}_{k}")
        # The floors keep the scatter positive definite; rounding cannot take it below a part of them.
        value = F.sqrt(F.greatest(left, F.lit(FLOORS[AXES[i]] ** 2 / 4))) if i == j else (
            left / F.col(f"low_{j}_{j}"))
        out = out.withColumn(f"low_{i}_{j}", value)
    for i in range(size):
        for j in range(i, -1, -1):
            if i == j:
                value = 1 / F.col(f"low_{i}_{i}")
            else:
                value = None
                for k in range(j, i):
                    part = F.col(f"low_{i}_{k}") * F.col(f"inv_{k}_{j}")
                    value = part if value is None else value + part
                value = -value / F.col(f"low_{i}_{i}")
            out = out.withColumn(f"inv_{i}_{j}", value)
    volume = sum((2 * F.log(f"low_{i}_{i}") for i in range(1, size)), 2 * F.log("low_0_0"))
    return out.select("group", *[f"mean_{i}" for i in range(size)],
                      *[f"inv_{i}_{j}" for i, j in _pairs()], volume.alias("size"))
