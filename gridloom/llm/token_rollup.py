"""Delta-maintained token counts by source, language and tokenizer version.

Totals are never recounted: a batch of changes (inserts, deletes, and revisions
as a delete of the old count with an insert of the new) is summed with its signs
to a few rows per source, language and version, and committed as one folder of
the store. Totals are the sums over all committed batches. A batch has a name,
and a name that was committed changes nothing when it comes again; a batch that
broke off has no mark of success, is not read, and is written anew when retried.

At scale: documents are tokenized once in tasks that need nothing from each
other; signs and sums combine before the shuffle, so a source with a third of
all rows is a row per task. ``compact`` folds many small batches into one
and keeps their names, so that these change nothing in the new store either.

Null sources and languages are groups of their own. Null or empty texts count
as documents without tokens. Repeated rows count as often as they occur; equal
texts are told apart by ``doc_id`` only. No changes commit an empty batch; a
store without batches has no totals. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.sqltext import dark_words, text_keys
from gridloom.llm.tokens import default_path, encode
from gridloom.session import materialize, scratch_path

KEYS = ["source", "lang", "version"]
COMPACTED = "compacted"
SUMS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long, n_chars long"


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, one, two, n_chars, bpe, words): counts by two tokenizers of every row, and its text's key."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(encode(t.as_py(), path)) for t in batch.column("text")], pa.int64())
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, "bpe", n)

    read = docs.select(
        "doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "text", *text_keys(),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.size(dark_words()).cast("long").alias("words"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, source string, lang string, bpe long, one long, two long, n_chars long, words long")


def changes(counts: DataFrame, version: str, tokens: str, sign: int) -> DataFrame:
    """Signed changes of one tokenizer version: 1 inserts, -1 deletes the documents of ``counts``."""
    return counts.select(
        "source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("n_docs"),
        (F.col(tokens) * sign).alias("n_tokens"), (F.col("n_chars") * sign).alias("n_chars"),
    )


def _path(spark: SparkSession, store: str, batch: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/batch={batch}")
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, store: str) -> list[str]:
    """Names of the batches with a mark of success."""
    root = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
    return sorted(n[6:] for n in names if n.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/_SUCCESS")))


def carried(spark: SparkSession, store: str) -> set[str]:
    """Names of the batches that ``compact`` folded into the store, known from its commit on."""
    if COMPACTED not in committed(spark, store):
        return set()
    return {r[0] for r in spark.read.schema("value string").text(f"{store}/carried").collect()}  # a name per commit


def commit(store: str, batch: str, signed: DataFrame) -> bool:
    """Sum the signed changes and commit them under ``batch``; False if that name is committed already."""
    spark = signed.sparkSession
    if not batch or not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a batch is named by letters, digits, - and _")
    place, files = _path(spark, store, batch)
    if files.exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")) or batch in carried(spark, store):
        return False
    sums = signed.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS])
    sums.write.mode("overwrite").parquet(place.toString())
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Totals by source, language and version over all committed batches; groups whose sums are all 0 are left out."""
    paths = [f"{store}/batch={b}" for b in committed(spark, store)]
    rows = spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs != 0 OR n_tokens != 0 OR n_chars != 0")


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Write the totals as the single batch of a new store, which knows the names of all batches in it."""
    names = sorted({*committed(spark, store), *carried(spark, store)} - {COMPACTED})
    spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/carried")
    commit(target, COMPACTED, totals(spark, store))


def corpus_rollup(docs: DataFrame, restore: bool = False) -> DataFrame:
    """Totals of a corpus after its insert, the removal of exact copies, and a revised tokenizer version.

    The load inserts every document under ``byte_bpe/1`` and ``words/1``. The
    clean-up deletes all copies of a text but the one with the least ``doc_id``.
    The revision replaces ``byte_bpe/1`` of the remaining documents by
    ``byte_bpe/2``, which counts the end id too. With ``restore`` the copies are
    inserted again under the revised versions, so that the totals are those of
    every row of ``docs``. Every batch is sent twice.
    """
    spark = docs.sparkSession
    counts = materialize(count_tokens(docs).withColumn("ended", F.col("bpe") + 1), "counts")
    firsts = counts.groupBy("one", "two").agg(F.min("doc_id").alias("first_id"))
    marked = counts.join(firsts, ["one", "two"]).withColumn("copy", ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    marked = materialize(marked.drop("one", "two", "first_id"), "marked")
    copies, stay = marked.where("copy"), marked.where("not copy")
    both = [("byte_bpe/1", "bpe"), ("words/1", "words")]
    load = changes(counts, *both[0], 1).unionByName(changes(counts, *both[1], 1))
    clean = changes(copies, *both[0], -1).unionByName(changes(copies, *both[1], -1))
    revise = changes(stay, *both[0], -1).unionByName(changes(stay, "byte_bpe/2", "ended", 1))
    back = changes(copies, "byte_bpe/2", "ended", 1).unionByName(changes(copies, *both[1], 1))
    sent = [("load", load), ("clean", clean), ("load", load), ("revise", revise), ("clean", clean), ("revise", revise)]
    store = scratch_path(spark, "rollup")
    for name, batch in sent + [("restore", back)] * 2 * restore:
        commit(store, name, batch)
    return totals(spark, store)
