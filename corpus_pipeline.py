"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it kept. All
but the last return the columns of ``docs``. ``run`` writes each stage's rows as Parquet in
the session's shared folder and reads them again for the next.

Rows without an id and rows that repeat one are documents of their own: the stages that
join a decision back to its document use a key of id and text where ids are not unique.
Empty tables pass through; null texts have no toxic term, no lines, no shingles and no
overlap, so they stay, and are packed as the one id that ends a document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from thresher.llm.decontaminate import benchmark_overlaps
from thresher.llm.language import held_out
from thresher.llm.lines import keep_first_lines
from thresher.llm.neardup import near_duplicates
from thresher.llm.packing import pack_documents
from thresher.llm.staging import staged
from thresher.llm.toxicity import drop_toxic, fit_toxicity

TOXIC_AT = 0.7
KEY = "__row_key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that tells its rows apart: the id if it can, else id and text."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    key = F.col("doc_id").cast("long") if ids == n else F.xxhash64("doc_id", "text")
    return docs.withColumn(KEY, key)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the weakly supervised classifier calls toxic."""
    learned = ~held_out("doc_id", 3, 1)
    model = fit_toxicity(docs.where(learned), _table(spark, sf_dir, "labels").where(learned))
    return drop_toxic(docs, model, TOXIC_AT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of lines that repeat; documents left without a word go."""
    kept = keep_first_lines(docs, min_tokens=1)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    keyed = _keyed(docs)
    found = near_duplicates(keyed.select(KEY, "text"), id_col=KEY).where("not kept").select(
        F.col("doc_id").alias(KEY))
    kept = keyed.join(found, KEY, "left_anti")
    if not keyed.groupBy(KEY).count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([KEY])       # equal rows
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    keyed = _keyed(docs)
    found = benchmark_overlaps(keyed.select(KEY, "text"), _table(spark, sf_dir, "benchmark"), id_col=KEY)
    return keyed.join(found.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", packing)]

# Models, SimHash and tokens are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
