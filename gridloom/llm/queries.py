"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.ball_tree import top_k
from gridloom.llm.block_labeller import extract
from gridloom.llm.chosen_path import near_duplicates
from gridloom.llm.filter_audit import audit
from gridloom.llm.importance import classify
from gridloom.llm.license_diagonals import license_scan
from gridloom.llm.packing import pack
from gridloom.llm.rank_index import fill_in_middle, restored
from gridloom.llm.robust_outliers import robust_quality
from gridloom.llm.secret_scan import secret_spans
from gridloom.llm.suffix_spans import remove_repeats
from gridloom.llm.token_rollup import corpus_rollup
from gridloom.llm.winnowing import contaminated

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_add("op1_importance_resampling")
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_add("op2_structural_secret_scan")
def structural_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


@_add("op3_delta_token_rollup")
def delta_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_rollup(_table(spark, sf_dir, "documents"), restore=True)


@_add("op4_diagonal_license_scan")
def diagonal_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


WINNOWING_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS x
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
found AS (SELECT p.doc_id, p.m, p.i, q.item_id FROM places p JOIN windows q ON p.x = q.x AND p.m = q.m),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY doc_id),
which AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN which USING (doc_id)
"""


@_add("op5_winnowing_decontamination", WINNOWING_SQL)
def winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("one", "two")


@_add("op6_chosen_path_near_dedup")
def chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("mark")


@_add("op7_recurrent_block_labeller")
def recurrent_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


@_add("op8_grouping_genetic_packing")
def grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


@_add("op9_robust_outlier_rules")
def robust_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_quality(_table(spark, sf_dir, "documents"))


@_add("op10_two_stage_suffix_dedup")
def two_stage_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


RANK_INDEX_SQL = r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, t, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM tokens),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:least(a, b)], '') AS prefix, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(t[greatest(a, b) + 1:], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@_add("op11_learned_rank_fim", RANK_INDEX_SQL)
def learned_rank_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


BALL_TREE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


@_add("op12_ball_tree_top_k", BALL_TREE_SQL)
def ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


FILTER_AUDIT_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS INT) AS mask
  FROM words w LEFT JOIN known USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask),
letters AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o, array_to_string(list_transform([a.i, b.i, c.i, d.i, e.i], lambda x: 'ABCDE'[x + 1:x + 1]), '') AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
places AS (
  SELECT filter_order, step, o[step] AS f, CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x)), 0) AS INT) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE mask & (before | (1 << f)) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & (1 << f) <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & (1 << f) <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = 1 << f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & (1 << f) <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & (1 << f) <> 0), 0) AS toxic_lost
  FROM cells, places GROUP BY part, filter_order, step, f, before)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


@_add("op13_gray_code_filter_audit", FILTER_AUDIT_SQL)
def gray_code_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
