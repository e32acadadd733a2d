"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of digits, letters and non-ASCII, A-Z lower-cased. A window is 13
consecutive words of a benchmark item (an item of 1 to 12 words is one window).
Every window of 13 words keeps the least hash of its nine 5-grams, so a window
shared by a document and an item has the same fingerprint on both sides: each
shared span of 13 words or more is found. Distinct fingerprints of a document
join those of the items; only in documents with a hit are windows extended to
all 13 words and joined to the items' windows. Fewer words than a fingerprint
needs have no guarantee, so the window of a short item has the hash of its head
as fingerprint (its first five words, or all of them), and documents add their
grams of the widths that occur to their fingerprints.

At scale: texts are read once for fingerprints (stored as arrays of distinct
hashes), whatever lengths items have, and those with a hit once more; copies
share a text key and fold before rows move; the items' tables are stored, so
that Spark knows their size when it chooses a join.

Null or empty texts have no words and are never hit; so are items without
words. A null ``item_id`` marks words but is not listed; repeated items count
once. Documents with equal text get equal results; repeated rows stay rows. An
empty benchmark hits nothing, an empty table gives no rows, and extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.sqltext import alnum_words, covered, grams, text_keys
from gridloom.session import materialize

WINDOW, GRAM = 13, 5


def _fingerprints(hashes: str) -> Column:
    """Least 5-gram hash of every window over the array column of 5-gram hashes."""
    across = WINDOW - GRAM + 1
    heads = F.slice(F.col(hashes), 1, F.greatest(F.size(hashes) - (across - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.least(x, *[F.get(F.col(hashes), i + j) for j in range(1, across)]))


def _prepared(table: DataFrame, widths: Sequence[int] = ()) -> DataFrame:
    """Adds ``words``, ``prints``, the fingerprint of the window at each word, and ``heads<n>``, the gram of n words at each."""
    return (
        table.withColumn("words", alnum_words())
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumns({"grams": grams("hashes", GRAM), **{f"heads{w}": grams("hashes", w) for w in widths}})
        .withColumn("prints", _fingerprints("grams"))
        .drop("hashes", "grams")
    )


def _starts(length: int) -> Column:
    """Places (start, length) where a window of ``length`` words has a hit as its fingerprint."""
    known, last = ("prints", F.size("prints") - 1) if length == WINDOW else (f"heads{min(length, GRAM)}", F.size("words") - length)
    places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i <= last) & F.array_contains("hits", F.get(F.col(known), i)))
    return F.transform(places, lambda i: F.struct(i.alias("start"), F.lit(length).alias("length")))


def _window_hashes(start: Column, length: Column) -> list[Column]:
    piece = F.slice(F.col("words"), start + 1, length)
    return [F.xxhash64(piece, F.size("words") * 0).alias("a"), F.xxhash64(F.lit(1), piece, F.size("words") * 0).alias("b")]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, one, two, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text", *text_keys())
    all_widths = range(1, GRAM + 1)
    items = _prepared(benchmark.select("item_id", "text"), all_widths).withColumn("n", F.size("words")).where("n > 0")
    head = F.coalesce(*[F.get(F.col(f"heads{w}"), F.lit(0)) for w in reversed(all_widths)])
    items = items.select("item_id", "words", "n", "prints", head.alias("head"))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0)))).alias("start")
    windows = items.select("item_id", "words", "n", "prints", "head", starts).select(
        "item_id", F.when(F.col("n") < WINDOW, F.col("head")).otherwise(F.get("prints", F.col("start"))).alias("print"), F.least("n", F.lit(WINDOW)).alias("length"),
        *_window_hashes(F.col("start"), F.least("n", F.lit(WINDOW))),
    )
    windows = materialize(windows.distinct(), "windows")
    plain = materialize(windows.select("a", "b", "length").distinct(), "plain")
    prints = materialize(windows.select("print").distinct(), "prints")
    short = sorted(r[0] for r in windows.where(F.col("length") < WINDOW).select("length").distinct().collect())
    widths = sorted({min(length, GRAM) for length in short})

    known = F.array_distinct(F.concat("prints", *[f"heads{w}" for w in widths]))
    read = _prepared(docs, widths).select("doc_id", "one", "two", F.size("words").cast("long").alias("n_words"), known.alias("prints"))
    read = materialize(read, "read")
    hit = read.select("one", "two", F.explode("prints").alias("print")).join(prints, "print")
    hit = materialize(hit.groupBy("one", "two").agg(F.collect_set("print").alias("hits")), "hit")

    # joined before it is cut into words: only texts with a hit are prepared again
    near = docs.select("text", F.col("one").alias("o"), F.col("two").alias("t"))
    near = near.join(hit, (F.col("o") == hit["one"]) & (F.col("t") == hit["two"])).select("one", "two", "text", "hits")
    near = _prepared(near, widths)
    near = near.select("one", "two", "words", F.explode(F.concat(*[_starts(length) for length in [WINDOW, *short]])).alias("at"))
    near = near.select("one", "two", "words", "at.start", "at.length")
    found = near.select("one", "two", "start", "length", *_window_hashes(F.col("start"), F.col("length")))
    found = materialize(found.join(plain, ["a", "b", "length"]).distinct(), "found")
    spans = F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("stop")))
    words = found.groupBy("one", "two").agg(spans.alias("s")).select("one", "two", covered(F.col("s")).alias("n_hit"))
    which = found.select("one", "two", "a", "b", "length").distinct().join(windows.select("a", "b", "length", "item_id").distinct(), ["a", "b", "length"])
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    which = which.groupBy("one", "two").agg(ids.alias("ids"))
    told = materialize(words.join(which, ["one", "two"], "left"), "told")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    return read.join(told, ["one", "two"], "left").select(
        "doc_id", "one", "two", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that are not contaminated."""
    bad = contaminated(docs, benchmark).where("contaminated").select(F.col("one").alias("_one"), F.col("two").alias("_two")).distinct()
    bad = materialize(bad, "contaminated")
    one, two = text_keys()
    return docs.join(bad, (one == bad["_one"]) & (two == bad["_two"]), "left_anti")
