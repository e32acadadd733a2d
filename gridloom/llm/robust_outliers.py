"""Quality rules with robust multivariate outliers, with DataFrame functions only.

Statistics of every whole text are transformed (logs of lengths and of counts
per word) and judged against their language and source: the minimum covariance
determinant estimate starts from medians and absolute deviations, keeps the
three quarters of the documents with the least distance, and re-estimates mean
and covariance from these in a few concentration steps, each of which lowers
the determinant. A document is rejected when its squared Mahalanobis distance
over all five statistics, scaled to the group's median, passes a cutoff.

At scale: texts are read once; the statistics, some ten numbers a document, are
stored and every step is a grouping combined before the shuffle. Quantiles come
from counted bins of fixed width, so a group of any size needs only its bins.
Group estimates join as a table with one row per group.

Null or empty texts have no words and fail the base rule. A null language or
source is a group of its own. A group with fewer than ``least`` usable documents
is judged with the others of its language, and that group alone if it is still
small. Ties and repeated rows count as often as they occur. An empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.sqltext import covered, dark_words, grams
from gridloom.session import materialize

#: Transformed statistics and the least deviation that counts as one, so that constant columns do no harm.
FLOORS = {"x_words": 0.30, "x_length": 0.04, "x_symbols": 0.15, "x_lines": 0.15, "x_repeats": 0.15}
NAMES = list(FLOORS)
BIN = 64.0
STEPS, SHARE, CUTOFF, LEAST = 3, 0.75, 60.0, 200
CHI_MEDIAN = 4.351


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", "lang", "source", text.alias("text"), dark_words().alias("words"))
    read = read.withColumn("threes", grams("words", 3))
    tagged = F.transform("threes", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    read = read.withColumn("ordered", F.when(F.size(F.array_distinct("threes")) < F.size("threes"), F.sort_array(tagged)))
    near = lambda i, d: F.get(F.col("ordered"), i + d)["g"]
    twice = F.filter("ordered", lambda s, i: F.coalesce(s["g"] == F.when(i > 0, near(F.greatest(i, F.lit(1)), -1)), F.lit(False)) | F.coalesce(s["g"] == near(i, 1), F.lit(False)))
    spans = F.transform(twice, lambda s: F.struct(s["i"].alias("start"), (s["i"] + 3).alias("stop")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return read.withColumn("lines", lines).select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(covered(spans), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def _vector() -> list[Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return [
        F.log1p("n_words").alias("x_words"),
        F.log1p(F.col("word_chars") / words).alias("x_length"),
        F.log1p(F.col("n_symbols") * 20 / words).alias("x_symbols"),
        F.sqrt(F.col("n_dup_lines") / lines).alias("x_lines"),
        F.sqrt(F.col("n_repeat_words") / words).alias("x_repeats"),
    ]


def _quantile(values: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """Upper edge of the bin in which the share of each key's rows is reached."""
    bins = values.groupBy(*keys, F.floor(F.col(value) * BIN).alias("bin")).count()
    order = Window.partitionBy(*keys)
    bins = bins.withColumn("upto", F.sum("count").over(order.orderBy("bin"))).withColumn("all", F.sum("count").over(order))
    return bins.where(F.col("upto") >= F.col("all") * share).groupBy(*keys).agg(((F.min("bin") + 1) / BIN).alias(name))


def _per_group(long: DataFrame, value: str, name: str) -> DataFrame:
    """One row per group with the median of every statistic as ``name``_<statistic>."""
    medians = _quantile(long, ["cell", "stat"], value, 0.5, "m")
    return medians.groupBy("cell").agg(*[F.max(F.when(F.col("stat") == n, F.col("m"))).alias(f"{name}_{n}") for n in NAMES])


def _stacked(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return rows.select("cell", F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), c.alias("v")) for n, c in columns.items()])))


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance, by the triangular factor of each group's covariance."""
    rows = rows.join(estimate, "cell")
    z: list[Column] = []
    for i, n in enumerate(NAMES):
        left = F.col(n) - F.col(f"m_{n}")
        for j in range(i):
            left = left - F.col(f"l_{i}_{j}") * F.col(f"z_{j}")
        rows = rows.withColumn(f"z_{i}", left / F.col(f"l_{i}_{i}"))
        z.append(F.col(f"z_{i}") * F.col(f"z_{i}"))
    total = z[0]
    for more in z[1:]:
        total = total + more
    drop = [f"z_{i}" for i in range(len(NAMES))] + [c for c in estimate.columns if c.startswith("l_")]
    return rows.withColumn("d", total).drop(*drop)


def _factored(moments: DataFrame) -> DataFrame:
    """Mean and triangular factor from sums per group; the floors keep it positive."""
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES[: i + 1]):
            value = F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}")
            if i == j:
                value = F.greatest(value, F.lit(0.0)) + FLOORS[a] ** 2
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(value, F.lit(FLOORS[a] ** 2 / 4))) if i == j else value / F.col(f"l_{j}_{j}")
            moments = moments.withColumn(f"l_{i}_{j}", value)
    return moments.select("cell", *[f"m_{n}" for n in NAMES], *[f"l_{i}_{j}" for i in range(len(NAMES)) for j in range(i + 1)])


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(NAMES) for j, b in enumerate(NAMES[: i + 1])]
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m_{n}") for n in NAMES], *sums)


def robust_quality(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) of every row."""
    stats = text_statistics(docs).withColumn(
        "base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    )
    stats = materialize(stats.select("*", *_vector()), "statistics")
    sizes = materialize(stats.where("not base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("usable")), "sizes")
    named = sizes.withColumnsRenamed({"lang": "l", "source": "s"})
    # null keys are spelled out, else a null source would share the cell of the pooled language
    named_cell = lambda *keys: F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    cell = F.when(F.col("usable") >= least, named_cell("lang", "source")).otherwise(named_cell("lang"))
    rows = stats.join(named, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    rows = materialize(rows.withColumn("cell", cell).drop("l", "s", "usable"), "cells")
    usable = rows.where("not base_failed").select("cell", *NAMES)
    centre = materialize(_per_group(_stacked(usable, {n: F.col(n) for n in NAMES}), "v", "m"), "centre")
    off = _stacked(usable.join(centre, "cell"), {n: F.abs(F.col(n) - F.col(f"m_{n}")) for n in NAMES})
    spread = _per_group(off, "v", "w")
    start = centre.join(spread, "cell")
    for i, n in enumerate(NAMES):
        for j in range(i):
            start = start.withColumn(f"l_{i}_{j}", F.lit(0.0))
        start = start.withColumn(f"l_{i}_{i}", F.greatest(F.col(f"w_{n}") * 1.4826, F.lit(FLOORS[n])))
    estimate = materialize(start.drop(*[f"w_{n}" for n in NAMES]), "estimate")
    for _ in range(STEPS):
        placed = _distance(usable, estimate).select("cell", *NAMES, F.log1p("d").alias("d"))
        bound = materialize(_quantile(placed, ["cell"], "d", SHARE, "bound"), "bound")
        half = placed.join(bound, "cell").where(F.col("d") <= F.col("bound"))
        estimate = materialize(_factored(_moments(half)), "estimate")
    placed = _distance(usable, estimate).select("cell", F.log1p("d").alias("d"))
    middle = materialize(_quantile(placed, ["cell"], "d", 0.5, "middle"), "middle")
    judged = _distance(rows.where("not base_failed"), estimate).join(middle, "cell")
    distance = F.col("d") * CHI_MEDIAN / F.greatest(F.expm1("middle"), F.lit(CHI_MEDIAN))
    judged = judged.withColumn("distance", distance).withColumn("kept", F.col("distance") <= cutoff)
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    failed = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    return judged.select(*out).unionByName(failed.select(*out))
