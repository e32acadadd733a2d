"""License scans by diagonal voting, with DataFrame functions only.

Words are runs of digits, letters and non-ASCII, A-Z lower-cased. Every rolling
3-gram of words is hashed; grams that occur in a template are joined to their
places there and vote for the diagonal (place in the text minus place in the
template). Votes are distinct template places per diagonal, so there are never
more than the template has words. Neighbouring diagonals (a few words inserted
or left out) merge into bands. The words around a band are then aligned with
the template: it becomes a span if at most a quarter of the template's words
changed, all words that tell the license from others (``MUST``) are there and
none of another license (``OTHER``) stands between. Grams only find bands: with
that many changes at least one gram of a template is left. Of the base phrases
a diagonal must hold every gram, which is the phrase word for word.

At scale: the templates are a fixed library of some hundred words. Texts are
read once; what moves are the few grams that occur in a template and the blocks
of words around them, once per text, so copies and hot sources fold before the
shuffle. A window is put together from its few blocks, however long the text.

Null or empty texts have no words, no labels and score 0. Repeated rows stay
rows with equal results. An empty table gives no rows; extra columns are
ignored. Equal votes are no matter, since each template is judged alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.sqltext import alnum_words, grams, text_keys
from gridloom.session import materialize

GRAM, DRIFT = 3, 4
CHANGED = 4  # one word in so many may change
BLOCK, AROUND, NEVER = 32, 2, 1000

# The base phrases and wordings of common licenses.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}
# Words without which a notice is not of this license, and words of its relatives.
MUST = {
    "mit": "permission deal restriction", "apache-2": "apache 2", "bsd": "redistribution source binary", "gpl-3": "gnu general public 3",
    "gpl": "gnu general public", "mpl-2": "mozilla 2", "cc-by": "creative commons attribution",
    "cc-by-sa": "creative commons attribution sharealike", "cc-by-nc": "creative commons attribution noncommercial",
}
_GNU, _CC = "lesser library affero", "noderivatives noderivs "
OTHER = {"gpl-3": _GNU, "gpl": _GNU, "cc-by": _CC + "noncommercial sharealike", "cc-by-sa": _CC + "noncommercial", "cc-by-nc": _CC + "sharealike"}
SPLIT = {"non commercial": "noncommercial", "share alike": "sharealike", "no derivatives": "noderivatives", "no derivs": "noderivs"}


def _templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, n, place, gram) of the library."""
    rows = [(i, label, base, words) for i, (label, base, words) in enumerate(
        [(k, True, v) for k, v in PHRASES.items()] + [(k, False, v) for k, v in TEMPLATES.items()]
    )]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, text string")
    table = table.withColumn("words", alnum_words()).withColumn("grams", grams("words", GRAM))
    return table.select("template", "label", "base", F.size("grams").alias("n"), F.posexplode("grams").alias("place", "gram"))


def _wordings(spark: SparkSession) -> DataFrame:
    """(label, told, must, other): words of each template and those that tell it from others."""
    rows = [(k, v.split(), MUST[k].split(), OTHER.get(k, "").split()) for k, v in TEMPLATES.items()]
    return spark.createDataFrame(rows, "label string, told array<string>, must array<string>, other array<string>")


def changed_words(words: str = "near") -> Column:
    """Least number of words changed, put in or left out between ``told`` and any part of ``words``.

    What touches a word of ``must`` or puts in one of ``other`` costs ``NEVER``.
    """
    fixed = F.transform("told", lambda t: F.when(F.array_contains("must", t), F.lit(NEVER)).otherwise(F.lit(1)))
    none = F.array(F.lit(0))
    first = F.aggregate(fixed, none, lambda cur, c: F.concat(cur, F.array(F.element_at(cur, -1) + c)))

    def column(row: Column, word: Column) -> Column:
        extra = F.when(F.array_contains("other", word), F.lit(NEVER)).otherwise(F.lit(1))

        def cell(cur: Column, j: Column) -> Column:
            told = F.get(F.col("told"), j)
            lost = F.when(F.array_contains("must", told), F.lit(NEVER)).otherwise(F.lit(1))
            swap = F.when(told == word, F.lit(0)).otherwise(F.greatest(lost, extra))
            best = F.least(F.get(row, j) + swap, F.get(row, j + 1) + extra, F.element_at(cur, -1) + lost)
            return F.concat(cur, F.array(best))

        return F.aggregate(F.sequence(F.lit(0), F.size("told") - 1), none, cell)

    def step(acc: Column, word: Column) -> Column:
        row = column(acc["row"], word)
        return F.struct(row.alias("row"), F.least(acc["best"], F.element_at(acc["row"], -1)).alias("best"))

    start = F.struct(first.alias("row"), F.lit(NEVER * NEVER).alias("best"))
    return F.aggregate(F.col(words), start, step, lambda acc: F.least(acc["best"], F.element_at(acc["row"], -1)))


def license_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, one, two, n_words) of every row, and per text (one, two, label, base, start, stop, score)."""
    spark = docs.sparkSession
    library = materialize(_templates(spark), "templates")
    known = [r[0] for r in library.select("gram").distinct().collect()]  # a few hundred, whatever the input
    read = docs.select("doc_id", "text", *text_keys()).withColumn("words", alnum_words()).withColumn("grams", grams("words", GRAM))
    spots = F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.get(F.col("grams"), i).isin(known))
    spots = F.when(F.size("grams") > 0, F.transform(spots, lambda i: F.struct(i.alias("at"), F.get(F.col("grams"), i).alias("gram"))))
    block = lambda s: F.floor(s["at"] / BLOCK).cast("int")
    wide = F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(block(s) - AROUND, block(s) + AROUND))))
    wide = F.filter(wide, lambda b: (b >= 0) & (b * BLOCK < F.size("words")))
    blocks = F.transform(wide, lambda b: F.struct(b.alias("block"), F.slice(F.col("words"), b * BLOCK + 1, BLOCK).alias("part")))
    read = read.withColumn("spots", spots).select(
        "doc_id", "one", "two", F.size("words").cast("long").alias("n_words"), "spots", F.when(F.size("spots") > 0, blocks).alias("blocks")
    )
    read = materialize(read, "read")
    votes = read.select("one", "two", F.inline("spots")).join(F.broadcast(library), "gram")
    diagonals = votes.groupBy("one", "two", "template", "label", "base", "n", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places")
    )
    diagonals = materialize(diagonals, "diagonals")
    exact = diagonals.where("base and size(places) = n").select(
        "one", "two", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n") + GRAM - 1).alias("stop"), F.lit(1.0).alias("score")
    )
    order = Window.partitionBy("one", "two", "template").orderBy("diagonal")
    jump = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"), F.lit(1))
    banded = diagonals.where("not base").withColumn("jump", jump).withColumn("band", F.sum("jump").over(order))
    banded = banded.groupBy("one", "two", "label", "base", "n", "band").agg(
        F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("places") + GRAM).alias("stop"),
        F.min("diagonal").alias("low"),
        F.max("diagonal").alias("high"),
    )
    # the words that an alignment with few enough changes can reach
    length = F.col("n") + GRAM - 1
    reach = F.floor(length / CHANGED).cast("int")
    banded = banded.withColumn("low", F.greatest(F.col("low") - reach, F.lit(0))).withColumn("high", F.col("high") + length + reach)
    parts = F.sequence(F.floor(F.col("low") / BLOCK).cast("int"), F.floor((F.col("high") - 1) / BLOCK).cast("int"))
    words = read.select("one", "two", F.inline("blocks")).dropDuplicates(["one", "two", "block"])
    near = banded.withColumn("block", F.explode(parts)).join(words, ["one", "two", "block"])
    near = near.groupBy("one", "two", "label", "base", "band", "start", "stop", "low", "high").agg(
        F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts")
    )
    skip = F.col("low") - F.get(F.col("parts"), 0)["block"] * BLOCK
    window = F.array_join(F.slice(F.flatten(F.col("parts")["part"]), skip + 1, F.col("high") - F.col("low")), " ")
    for two, one in SPLIT.items():
        window = F.regexp_replace(window, rf"(?<![^ ]){two}(?![^ ])", one)
    near = near.select("one", "two", "label", "base", "start", "stop", F.split(window, " ").alias("near")).join(F.broadcast(_wordings(spark)), "label")
    kinds = F.size(F.array_distinct("told")) - F.size(F.array_intersect("told", "near"))
    # without these words no alignment can do; only what is left is aligned
    likely = near.where((F.size(F.array_except("must", "near")) == 0) & (kinds * CHANGED <= F.size("told")))
    aligned = materialize(materialize(likely, "likely").withColumn("changed", changed_words()), "aligned")
    spans = aligned.where(F.col("changed") * CHANGED <= F.size("told")).withColumn("score", 1 - F.col("changed") / F.size("told"))
    return read.drop("spots", "blocks"), exact.unionByName(spans.select(*exact.columns))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``."""
    read, spans = license_spans(docs)
    own = F.when(F.col("base"), F.col("start")).cast("long")
    told = spans.groupBy("one", "two").agg(
        F.count(own).alias("n_base"),
        F.min(own).alias("first_word"),
        F.max(own).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    nothing = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    whole = read.join(materialize(told, "told"), ["one", "two"], "left").na.fill(nothing)
    return whole.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
