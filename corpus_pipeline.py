"""The corpus pipeline: five stages over documents, each on what the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontamination, ngram_join, quality_rules, source_mixing, substring_dedup
from loomwork.llm.catalogue import KEPT_TEXT, LEFT_TEXT, MIX_DRAWS, ORACLE
from loomwork.session import load_table, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules don't reject, without the lines above the limits."""
    return quality_rules.cleaned_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar ones, unchanged."""
    return ngram_join.one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; n_chars follows a changed text, and nothing left goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    done = substring_dedup.remove_repeats(docs, keep=[*others, "n_chars"]).filter("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    done = done.withColumns({"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))})
    return done.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, unchanged."""
    return decontamination.without_leaks(docs, load_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, with the pass and the shard that draws it; each shard shuffled."""
    return source_mixing.shuffled_rows(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = load_table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, "pipeline")
    return docs


def over(sql: str, table: str) -> str:
    """An operator's SQL, read from another table than documents."""
    return f"({sql.replace('FROM documents', f'FROM {table}')})"


ORACLE_SQL = f"""
WITH rated AS MATERIALIZED (
  SELECT d.doc_id, coalesce(l.left_text, d.text) AS text, d.lang, d.source, CASE WHEN l.left_text IS NULL THEN d.n_chars ELSE CAST(length(l.left_text) AS BIGINT) END AS n_chars
  FROM documents d JOIN {over(ORACLE["op6_quality_rules"], "documents")} v USING (doc_id) LEFT JOIN {over(LEFT_TEXT, "documents")} l USING (doc_id) WHERE v.kept
), single AS MATERIALIZED (
  SELECT d.* FROM rated d JOIN {over(ORACLE["op2_ngram_join"], "rated")} v USING (doc_id) WHERE v.component_id = d.doc_id
), cut AS MATERIALIZED (
  SELECT d.doc_id, CASE WHEN v.n_removed > 0 THEN v.kept_text ELSE d.text END AS text, d.lang, d.source,
    CASE WHEN v.n_removed > 0 THEN CAST(length(v.kept_text) AS BIGINT) ELSE d.n_chars END AS n_chars
  FROM single d JOIN {over(KEPT_TEXT, "single")} v USING (doc_id) WHERE v.n_removed = 0 OR v.n_removed < v.n_words
), clean AS MATERIALIZED (
  SELECT * FROM cut WHERE doc_id NOT IN (SELECT doc_id FROM {over(ORACLE["op10_decontamination"], "cut")})
)
SELECT d.*, v.pass, v.shard FROM clean d JOIN {over(MIX_DRAWS, "clean")} v USING (doc_id) WHERE v.shard IS NOT NULL
"""
