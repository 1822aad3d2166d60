"""Corpus pipeline: toxicity, line dedup, near duplicates, benchmark
decontamination, mixing. Each stage works on all its predecessor kept.

``run`` writes every stage's result as Parquet to the shared folder and reads it
as the next one's input. The classifier stage learns from labels, so the
pipeline has no SQL; the other stages are tested one by one against plain Python
(tests/llm/test_queries.py), the classifier by its held-out labels and by row.

Every stage takes documents (doc_id, text, lang, source, n_chars; other columns
are left out) with nulls in any column, empty, blank and very long texts, repeated
rows and rows without an id; an empty table stays empty. What becomes of such
rows is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, line_dedup, mixing, ngram_join, toxicity
from ledgerloom.llm.common import batches, materialize, small_enough, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def _chosen(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id is (``left_semi``) or isn't (``left_anti``) in
    the written table ``ids``."""
    return docs.join(F.broadcast(ids) if small_enough(ids, F.lit(24), 32 << 20) else ids, "doc_id", how)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go, each by its own text, with or without an id; all
    others stay, null and blank texts among them. Learns from the labels that
    aren't held out."""
    batches(spark)
    labels = table(spark, sf_dir, "labels").where(toxicity.remainder(F.col("doc_id")) != 2)
    scored = toxicity.toxicity_scores(docs.select(*COLUMNS), labels, keep=tuple(COLUMNS[1:]))
    return scored.where("predicted = 0").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go from the texts, n_chars follows. A
    document goes if its lines went and no word is left; one that had none stays.
    Rows of one id and text are judged as one; a row without an id keeps all."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), exact_chars=1)
    out = out.where((F.col("n_removed") == 0) | ~line_dedup.is_blank(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or
    more) the document of least id stays. Texts without words, and rows without an
    id, are in no group; rows of one id stay or go together."""
    batches(spark)
    groups = ngram_join.ngram_components(docs.select(*COLUMNS), shingle=5, percent=80, rounds=2)
    copies = materialize(groups.where("component_id <> doc_id").select("doc_id"), "copies")
    return _chosen(docs, copies.distinct(), "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more is hit by benchmark windows,
    each row by its own text, with or without an id."""
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words the mix takes of them (``taken``; repeats counted),
    in mixing order; those of which it takes none go, texts without words among
    them. Each row has its own share, also where an id is repeated. Texts are neither
    cut nor repeated: that is for the reader, by ``taken``. A null source is one of
    its own."""
    plan = mixing.mix_sources(docs.select(*COLUMNS), keep=tuple(COLUMNS[1:])).where("taken > 0")
    return plan.select(*COLUMNS, "taken", "virtual_finish").orderBy("virtual_finish", "doc_id")


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
