"""Column expressions on text shared by the operators."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_keys() -> list[Column]:
    """Two 64-bit hashes that name a text; copies share them, null is like empty."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two")]


def alnum_words() -> Column:
    """Words of digits, letters and non-ASCII of ``text``, A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def dark_words() -> Column:
    """Words of ``text`` between ASCII white space; null has none."""
    return F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def grams(words: str, width: int) -> Column:
    """Hash of every ``width`` consecutive elements of the array column ``words``.

    The column must be one of a stored or earlier projection; it is named more
    than once, so that the optimiser never inlines it into the loop.
    """
    rest = [lambda i, j=j: F.get(F.col(words), i + j) for j in range(1, width)]
    heads = F.slice(F.col(words), 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, *[r(i) for r in rest]))


def covered(spans: Column) -> Column:
    """Positions covered by an array of structs (start, stop), overlaps counted once."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, s: Column) -> Column:
        stop = s["stop"].cast("long")
        more = F.greatest(F.lit(0).cast("long"), stop - F.greatest(acc["end"], s["start"].cast("long")))
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["total"] + more).alias("total"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["total"])
