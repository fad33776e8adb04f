"""A training-corpus pipeline over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is
written as Parquet and read again as the next stage's docs.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstrata.llm import decontaminate, ngram_join, pieces, pii, queries, toxicity
from lumenstrata.llm.common import fresh, materialize, small_side, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    (score,) = fresh(docs.columns, "tox_score")
    return scored.filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.  Rows without an id, and all rows of a kept id, stay."""
    classes = ngram_join.ngram_classes(docs).filter("doc_id is not null")
    later = classes.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("class_id")).alias("first")).filter("not first").select("doc_id")
    return docs.join(small_side(materialize(later, "later"), 16), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    (flag,) = fresh(docs.columns, "contaminated")
    return found.filter(~F.col(flag)).select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by placeholders; every document stays."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation, and the scores of the best few."""
    docs = docs.select("doc_id", "text", "lang", "source")
    out = pieces.encode_pieces(docs, f"{queries.TOKENIZERS}/{queries.PIECE_MODEL}")
    return out.select("doc_id", "text", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "nbest_scores", "round_trip", "piece_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("sentencepiece", encode),
]

#: No SQL expresses the learned and iterative stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
